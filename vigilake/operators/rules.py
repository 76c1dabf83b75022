"""The rule table: what each detection counts, by which key, and from how many on.

A rule is a row. ``detect`` takes any list of rows, so thresholds are settings and a new
threshold rule over an existing flag is one more row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    log_types: tuple[str, ...]
    shape: str  # keyed | total | distinct | sequence
    flag: str
    key: str  # column whose values are listed as evidence or counted
    threshold: int
    order: int
    severity: str = ""
    mitre_technique: str = ""
    title: str = ""
    description: str = ""
    keywords: tuple[str, ...] = ()
    event_ids: tuple[int, ...] = ()
    prefixed: bool = False  # the log type is put before the name


AUTH, WEB, WIN = ("auth",), ("apache",), ("windows",)
GENERIC = tuple(fixed.GENERIC_TYPES)

# id, log types, shape, flag, key, threshold; same order as the texts
_LOGIC = [
    ("d1", AUTH, "keyed", "is_failed_auth", "src_ip", 5),
    ("d2", AUTH, "distinct", "is_invalid_user", "username", 5),
    ("d3", AUTH, "total", "is_root_login", "src_ip", 1),
    ("d4", AUTH, "sequence", "is_accepted_auth", "src_ip", 1),
    ("d5", WEB, "total", "is_sqli", "src_ip", 1),
    ("d6", WEB, "total", "is_xss", "src_ip", 1),
    ("d7", WEB, "total", "is_path_traversal", "src_ip", 1),
    ("d8", WEB, "total", "is_webshell", "src_ip", 1),
    ("d9", WEB, "total", "is_scanner", "src_ip", 1),
    ("d10", WEB, "keyed", "is_4xx", "src_ip", 20),
    ("d11", WIN, "total", "is_failed_logon", "src_ip", 5),
    ("d12", WIN, "total", "is_service_install", "src_ip", 1),
    ("d13", WIN, "total", "is_scheduled_task", "src_ip", 1),
    ("d14", WIN, "total", "is_account_created", "src_ip", 1),
    ("d15", WIN, "total", "is_group_modified", "src_ip", 1),
    ("d16", WIN, "total", "is_log_cleared", "src_ip", 1),
    ("d17", WIN, "total", "is_kerberoast", "src_ip", 3),
    ("d18", GENERIC, "keyed", "is_failed_auth", "src_ip", 5),
    ("d19", GENERIC, "keyed", "is_denied", "src_ip", 10),
    ("d20", GENERIC, "keyed", "is_error_status", "src_ip", 20),
    ("d21", GENERIC, "total", "is_sensitive_action", "action", 1),
    ("d22", GENERIC, "total", "is_failed_logon", "src_ip", 5),
    ("d23", GENERIC, "total", "is_log_cleared", "src_ip", 1),
    ("d24", GENERIC, "total", "is_kerberoast", "src_ip", 3),
    ("d25", GENERIC, "total", "is_service_install", "src_ip", 1),
    ("d26", GENERIC, "total", "is_group_modified", "src_ip", 1),
]

RULES = [
    Rule(
        *logic[:1], texts[0], *logic[1:], order=n, severity=texts[1],
        mitre_technique=texts[2], title=texts[3], description=texts[4],
        keywords=tuple(texts[5]), event_ids=tuple(texts[6]), prefixed=n >= 21,
    )
    for n, (logic, texts) in enumerate(zip(_LOGIC, fixed.RULE_TEXTS, strict=True))
]


def rules(log_types=None, ids=None, thresholds: dict[str, int] | None = None) -> list[Rule]:
    """Rule rows, by log type and/or id, with other thresholds by id where given."""
    chosen = [
        r for r in RULES
        if (log_types is None or set(r.log_types) & set(log_types))
        and (ids is None or r.id in ids)
    ]
    return [replace(r, threshold=(thresholds or {}).get(r.id, r.threshold)) for r in chosen]


def rule_dimension(spark: SparkSession, chosen: list[Rule]) -> DataFrame:
    """Rule texts as a table of a few dozen rows, one per rule, built from literals."""
    def strings(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    rows = [
        F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("_name"),
            F.lit(r.prefixed).alias("_prefixed"),
            F.lit(r.title).alias("title"), F.lit(r.description).alias("description"),
            F.lit(r.severity).alias("severity"), F.lit(r.mitre_technique).alias("mitre_technique"),
            strings(r.keywords).alias("_keywords"),
            F.array(*[F.lit(i) for i in r.event_ids]).cast("array<int>").alias("event_ids"),
            F.lit(r.order).alias("rule_order"), F.lit(r.threshold).alias("_threshold"),
        )
        for r in chosen
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
