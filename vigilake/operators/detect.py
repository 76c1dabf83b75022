"""Keyed threshold detections over events.

Shape of the job, per log family:

1. one ``groupBy(scope, key)`` over the scan computes, for every rule at once, hits,
   first hit and the record of the first hit (map-side combined, so a hot address or a
   hot file shrinks to one row per task before the shuffle);
2. those aggregated rows are ranked inside ``(scope, rule, salt)`` so that the evidence
   lists of one huge scope are built by many tasks;
3. ``groupBy(scope, rule)`` merges the salted parts and applies the threshold.

Events themselves are never collected into lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from vigilake.operators.rules import Rule, rule_dimension, rules
from vigilake.schema import flag

LISTED = 10  # longest evidence list of any rule

EVIDENCE = {
    "offending_ips": "array<string>", "offending_sources": "array<string>",
    "max_attempts": "bigint", "max_events": "bigint", "threshold": "int",
    "invalid_users_count": "bigint", "sample_users": "array<string>",
    "attempt_count": "bigint", "src_ip": "string", "failed_before": "bigint",
    "sample_paths": "array<string>", "accessed_paths": "array<string>",
    "scanner_uas": "array<string>", "total_failures": "bigint",
    "top_source_ips": "map<string,bigint>", "ticket_requests": "bigint",
    "action_counts": "map<string,bigint>",
}
FINDING_COLUMNS = [
    "scope", "log_type", "rule_name", "title", "description", "severity",
    "mitre_technique", "hit_count", "sample_entry", "evidence", "event_ids", "keywords",
    "log_source", "rule_order",
]


def _scoped(events: DataFrame, scope: str, order: str, log_types) -> DataFrame:
    """Events of the wanted types under the names used here."""
    renamed = {"scope": F.col(scope), "seq": F.col(order)}
    return events.filter(F.col("log_type").isin(list(log_types))).withColumns(renamed)


def _present(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


# --------------------------------------------------------------------------- step 1
def key_profile(events: DataFrame, chosen: list[Rule]) -> DataFrame:
    """Per (scope, log type, kind of key, key): hits, first hit and its record, per rule.

    Every record counts under its source address; a record hit by a rule on another key
    (user name, action) counts once more under that key.
    """
    other = {}
    for r in chosen:
        if r.key != "src_ip":
            other.setdefault(r.key, []).append(r)
    keys = [F.struct(F.lit("src_ip").alias("kind"), _present("src_ip").alias("key"))]
    for name, of_key in other.items():
        hit = reduce(lambda a, b: a | b, [flag(r.flag) for r in of_key])
        value = F.coalesce(F.col(name), F.lit("unknown")) if name == "action" else _present(name)
        keys.append(F.when(hit & value.isNotNull(), F.struct(F.lit(name).alias("kind"), value.alias("key"))))
    flags = sorted({r.flag for r in chosen})
    if all(r.shape != "distinct" for r in chosen):
        # only hits count; the distinct rule alone also wants a scope's first record
        events = events.filter(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))
    rows = events.select(
        "scope", "log_type", "seq", "raw", *[flag(f).alias(f) for f in flags],
        F.explode(F.array_compact(F.array(*keys))).alias("k") if other else keys[0].alias("k"),
    ).select("scope", "log_type", "seq", "raw", *flags, "k.kind", "k.key")

    measures = []
    for r in chosen:
        hit = F.col(r.flag) & (F.col("kind") == r.key)
        position = F.when(hit, F.col("seq"))
        measures += [
            F.count_if(hit).alias(f"n_{r.id}"),
            F.min(position).alias(f"first_{r.id}"),
            F.min_by("raw", position).alias(f"raw_{r.id}"),
        ]
    if any(r.shape == "distinct" for r in chosen):
        anywhere = F.when(F.col("kind") == "src_ip", F.col("seq"))
        measures += [F.min(anywhere).alias("first_any"), F.min_by("raw", anywhere).alias("raw_any")]
    return hashed(rows.groupBy("scope", "log_type", "kind", "key"), measures)


def hashed(groups: GroupedData, measures: list[Column]) -> DataFrame:
    """The measures by a hash aggregate of objects.

    Texts among the measures would make Spark sort all rows by key, with their texts, before it
    combines them. One collecting measure has it keep the groups in a hash table of objects instead;
    a task with very many keys still falls back to sorting. It collects nothing, and its size is added
    to the first measure, a number that callers use: an unused measure would be pruned.
    """
    found = groups.agg(*measures, F.collect_list(F.lit(None).cast("int")).alias("_none"))
    first = found.columns[-1 - len(measures)]
    return found.withColumn(first, F.col(first) + F.size("_none")).drop("_none")


def _salts(df: DataFrame) -> int:
    """As many parts per scope as the job has shuffle partitions, within bounds: a part
    hands on at most ``LISTED`` rows per list, so the merge stays small."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), 1024)


def _rule_rows(profile: DataFrame, chosen: list[Rule]) -> DataFrame:
    """Profile -> one row per (rule, key) that counts for the rule."""
    def row(r: Rule, key: Column, n: Column, first: Column, raw: Column):
        return F.struct(
            F.lit(r.id).alias("rule_id"), key.cast("string").alias("name"),
            n.cast("bigint").alias("n"), first.alias("first"), raw.alias("raw"),
        )

    rows = []
    for r in chosen:
        n, first, raw = F.col(f"n_{r.id}"), F.col(f"first_{r.id}"), F.col(f"raw_{r.id}")
        counts = (F.col("kind") == r.key) & (n > 0)
        key = F.col("key")
        if r.shape == "keyed":
            counts = counts & key.isNotNull() & (n >= r.threshold)
        elif r.shape == "distinct":
            # the sample is the first record of the scope, whatever it holds
            rows.append(F.when(
                F.col("kind") == "src_ip",
                row(r, F.lit(None), F.lit(0), F.col("first_any"), F.col("raw_any")),
            ))
            raw = F.lit(None).cast("string")
        if r.shape == "total":
            key = F.coalesce(key, F.lit("unknown"))
        rows.append(F.when(counts, row(r, key, n, first, raw)))
    return profile.select(
        "scope", "log_type",
        F.pmod(F.xxhash64("kind", "key"), F.lit(_salts(profile))).alias("salt"),
        F.explode(F.array_compact(F.array(*rows))).alias("r"),
    ).select("scope", "log_type", "salt", "r.*")


# --------------------------------------------------------------------------- steps 2, 3
def _fired(rule_rows: DataFrame) -> DataFrame:
    """Rule rows -> one row per (scope, rule) with totals and bounded evidence lists."""
    part = Window.partitionBy("scope", "log_type", "rule_id", "salt")
    named = F.col("name").isNotNull()
    ranked = rule_rows.withColumns({
        "by_first": F.row_number().over(part.orderBy(F.col("name").isNull(), "first")),
        "by_count": F.row_number().over(part.orderBy(F.col("name").isNull(), F.desc("n"), "first")),
    })
    largest_first = F.struct((-F.col("n")).alias("less"), F.col("first"))
    return ranked.groupBy("scope", "log_type", "rule_id").agg(
        F.sum("n").alias("hits"),
        F.count_if(named).alias("names"),
        F.max("n").alias("largest"),
        F.min_by("raw", F.when(F.col("raw").isNotNull(), F.col("first"))).alias("first_raw"),
        F.min_by("raw", largest_first).alias("largest_raw"),
        F.min_by("name", largest_first).alias("largest_name"),
        F.array_sort(F.collect_list(F.when(
            named & (F.col("by_first") <= LISTED), F.struct("first", "name")
        )))["name"].alias("first_names"),
        F.slice(F.array_sort(F.collect_list(F.when(
            named & (F.col("by_count") <= LISTED),
            F.struct((-F.col("n")).alias("less"), "first", "name", "n"),
        ))), 1, LISTED).alias("top_names"),
    )


def first_hits(events: DataFrame, chosen: list[Rule], k: int) -> DataFrame:
    """First k matching web records per (scope, rule), in order, as one small array.

    The rank filter is applied before the shuffle as well, so each task sends at most k
    records per group.
    """
    hit = F.array_compact(F.array(*[F.when(flag(r.flag), F.lit(r.id)) for r in chosen]))
    any_hit = reduce(lambda a, b: a | b, [F.col(r.flag) for r in chosen])
    rows = events.filter(any_hit).select(
        "scope", "log_type", "seq", "path", "useragent", F.explode(hit).alias("rule_id")
    )
    order = Window.partitionBy("scope", "log_type", "rule_id").orderBy("seq")
    return (
        rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .groupBy("scope", "log_type", "rule_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "path", "useragent"))).alias("records"))
    )


def _evidence() -> Column:
    """The evidence struct, members by rule id; members a rule does not have are NULL."""
    def of(ids, value):
        return F.when(F.col("rule_id").isin(ids), value)

    first = F.col("first_names")
    paths = F.col("records")["path"]
    top5 = F.slice("top_names", 1, 5)
    members = {
        "offending_ips": of(["d1", "d10"], F.slice(first, 1, 5)),
        "offending_sources": of(["d18", "d19", "d20"], F.slice(first, 1, 5)),
        "max_attempts": of(["d1", "d18"], F.col("largest")),
        "max_events": of(["d19"], F.col("largest")),
        "threshold": of(["d1", "d10", "d18", "d19", "d20"], F.col("_threshold")),
        "invalid_users_count": of(["d2"], F.col("names")),
        "sample_users": of(["d2"], F.slice(first, 1, 10)),
        "attempt_count": of(["d3"], F.col("hits")),
        "src_ip": of(["d4"], F.col("largest_name")),
        "failed_before": of(["d4"], F.col("hits")),
        "sample_paths": of(["d5", "d6", "d7"], F.transform(F.slice(paths, 1, 3), lambda p: F.substring(p, 1, 120))),
        "accessed_paths": of(["d8"], F.slice(paths, 1, 5)),
        "scanner_uas": of(["d9"], F.array_distinct(
            F.transform(F.slice(F.col("records")["useragent"], 1, 5), lambda u: F.substring(u, 1, 80))
        )),
        "total_failures": of(["d11", "d22"], F.col("hits")),
        "top_source_ips": of(["d11"], F.map_from_arrays(top5["name"], top5["n"])),
        "ticket_requests": of(["d17", "d24"], F.col("hits")),
        "action_counts": of(["d21"], F.map_from_arrays(F.col("top_names")["name"], F.col("top_names")["n"])),
    }
    return F.struct(*[members[n].cast(t).alias(n) for n, t in EVIDENCE.items()])


def _findings(fired: DataFrame, chosen: list[Rule]) -> DataFrame:
    """Fired rows + rule texts -> findings. The rule table holds one row per rule, a few
    dozen at most, so its broadcast does not grow with the data."""
    by_shape = {s: [r.id for r in chosen if r.shape == s] for s in ("keyed", "distinct")}
    keyed, distinct = F.col("rule_id").isin(by_shape["keyed"]), F.col("rule_id").isin(by_shape["distinct"])
    hits = F.when(distinct, F.col("names")).otherwise(F.col("hits"))
    sample = F.when(F.col("rule_id") == "d10", F.lit(None)).when(keyed, F.col("largest_raw")).otherwise(F.col("first_raw"))
    joined = fired.join(F.broadcast(rule_dimension(fired.sparkSession, chosen)), "rule_id")
    # a keyed rule has applied its threshold per key already
    return joined.filter(keyed | (hits >= F.col("_threshold"))).select(
        "scope", "log_type",
        F.when(F.col("_prefixed"), F.concat_ws("_", "log_type", "_name")).otherwise(F.col("_name")).alias("rule_name"),
        "title", "description", "severity", "mitre_technique",
        hits.cast("bigint").alias("hit_count"),
        # one rule reports only the address it is about
        F.when(F.col("rule_id") == "d10", F.col("largest_name")).otherwise(sample).alias("sample_entry"),
        _evidence().alias("evidence"),
        "event_ids",
        F.when(F.col("rule_id") == "d21", F.slice("first_names", 1, 10)).otherwise(F.col("_keywords")).alias("keywords"),
        F.col("log_type").alias("log_source"),
        "rule_order",
    )


# --------------------------------------------------------------------------- sequence rule
def success_after_failures(events: DataFrame) -> DataFrame:
    """Addresses with an accepted login at or after their first failure, per scope:
    failures, first such success, and the record of the latest success.

    One aggregate per (scope, address) settles every address but those that logged in
    both before and after their first failure; only for these is the first success after
    it looked up in the accepted records.
    """
    known = events.filter("src_ip <> ''")
    failed, accepted = flag("is_failed_auth"), flag("is_accepted_auth")
    per_address = hashed(known.filter("is_failed_auth or is_accepted_auth").groupBy("scope", "log_type", "src_ip"), [
        F.count_if(failed).alias("failures"),
        F.min(F.when(failed, F.col("seq"))).alias("first_failure"),
        F.min(F.when(accepted, F.col("seq"))).alias("first_accept"),
        F.max(F.when(accepted, F.col("seq"))).alias("last_accept"),
        F.max_by("raw", F.when(accepted, F.col("seq"))).alias("sample"),
    ]).filter("last_accept >= first_failure")
    open_ = per_address.filter("first_accept < first_failure").select("scope", "log_type", "src_ip", "first_failure")
    later = (
        known.filter("is_accepted_auth").select("scope", "log_type", "src_ip", "seq")
        .join(open_, ["scope", "log_type", "src_ip"])
        .filter("seq >= first_failure")
        .groupBy("scope", "log_type", "src_ip").agg(F.min("seq").alias("later_accept"))
    )
    settled = F.when(F.col("first_accept") >= F.col("first_failure"), F.col("first_accept"))
    return per_address.join(later, ["scope", "log_type", "src_ip"], "left").select(
        "scope", "log_type", "src_ip", "failures",
        F.coalesce(settled, F.col("later_accept")).alias("first_success"), "sample",
    )


def _sequence_fired(events: DataFrame) -> DataFrame:
    """One row per scope: the address whose success after failures came first."""
    earliest = F.min_by(F.struct("src_ip", "failures", "sample"), "first_success")
    return success_after_failures(events).groupBy("scope", "log_type").agg(earliest.alias("e")).select(
        "scope", "log_type", F.lit("d4").alias("rule_id"),
        F.col("e.failures").alias("hits"), F.lit(1).cast("bigint").alias("names"),
        F.col("e.failures").alias("largest"), F.col("e.sample").alias("first_raw"),
        F.col("e.sample").alias("largest_raw"), F.col("e.src_ip").alias("largest_name"),
    )


# --------------------------------------------------------------------------- entry points
def detect(events: DataFrame, chosen: list[Rule], scope: str = "source_file", order: str = "seq") -> DataFrame:
    """Findings of the chosen rules (all of one log family) over events."""
    log_types = sorted({t for r in chosen for t in r.log_types})
    scoped = _scoped(events, scope, order, log_types)
    counting = [r for r in chosen if r.shape != "sequence"]
    listing = [r for r in counting if r.id in ("d5", "d6", "d7", "d8", "d9")]
    parts = []
    if counting:
        parts.append(_fired(_rule_rows(key_profile(scoped, counting), counting)))
    if len(counting) < len(chosen):
        parts.append(_sequence_fired(scoped))
    fired = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if listing:
        fired = fired.join(first_hits(scoped, listing, 5), ["scope", "log_type", "rule_id"], "left")
    else:
        none = F.lit(None).cast("array<struct<rank:int,path:string,useragent:string>>")
        fired = fired.withColumn("records", none)
    if not counting:
        fired = fired.withColumns({
            "first_names": F.lit(None).cast("array<string>"),
            "top_names": F.lit(None).cast("array<struct<less:bigint,first:bigint,name:string,n:bigint>>"),
        })
    return _findings(fired, chosen)


def detect_rule(events: DataFrame, rule_id: str, threshold: int | None = None,
                scope: str = "source_file", order: str = "seq") -> DataFrame:
    """Findings of one rule."""
    thresholds = None if threshold is None else {rule_id: threshold}
    return detect(events, rules(ids=[rule_id], thresholds=thresholds), scope, order)


def detect_all(events: DataFrame, thresholds: dict[str, int] | None = None,
               scope: str = "source_file", order: str = "seq") -> DataFrame:
    """Findings of every rule for every log type: each family reads only its own types."""
    families = (["auth"], ["apache"], ["windows"], ["csv"])
    parts = [detect(events, rules(log_types=f, thresholds=thresholds), scope, order) for f in families]
    return reduce(DataFrame.unionByName, parts)
