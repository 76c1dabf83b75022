"""Findings -> portable rules and searches, one row each, and the sinks for them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import text
from vigilake.session import written

AUTHOR = "Vigilake"


def _lookup(table: dict, key: Column, default: Column) -> Column:
    literal = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])
    return F.coalesce(F.try_element_at(literal, key), default)


def log_source(log_type: Column) -> Column:
    """Product, service and category of a log type."""
    def source(values):
        return F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("product", "service", "category"), values)])

    return _lookup({k: source(v) for k, v in fixed.LOG_SOURCES.items()}, log_type, source(fixed.DEFAULT_LOG_SOURCE))


def false_positives(rule_name: Column) -> Column:
    def lines(values):
        return F.array(*[F.lit(v) for v in values])

    return _lookup({k: lines(v) for k, v in fixed.FALSE_POSITIVES.items()}, rule_name, lines(fixed.DEFAULT_FALSE_POSITIVES))


def rule_id(scope: Column, rule_name: Column) -> Column:
    """A stable identifier in UUID form from scope and rule name."""
    digest = F.md5(F.concat_ws("|", scope, rule_name))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def detection() -> Column:
    """Selection (field -> values), condition and time frame of a finding's rule."""
    source, name = F.col("log_source"), F.col("rule_name")
    keywords = F.coalesce("keywords", F.array().cast("array<string>"))
    ids = F.transform(F.coalesce("event_ids", F.array().cast("array<int>")), lambda i: i.cast("string"))
    has_words, has_ids = F.size(keywords) > 0, F.size(ids) > 0
    generic = source.isin(fixed.GENERIC_TYPES)
    threshold = F.col("evidence.threshold")

    words = F.create_map(F.lit("keywords"), F.when(has_words, keywords).otherwise(F.array(name)))
    by_id = F.create_map(F.lit("EventID"), ids)
    query = F.create_map(
        F.lit("cs-uri-query|contains|all"), F.slice(keywords, 1, 3), F.lit("cs-uri-query|contains"), keywords
    )
    fields = F.create_map(F.lit("fields|contains"), keywords)
    counted = name.contains("brute_force") | ((source == "windows") & name.contains("spray"))
    brute_force = has_ids & F.coalesce(counted, F.lit(False))

    def over(key: str) -> Column:
        return F.concat(F.lit(f"selection | count() by {key} > "), F.coalesce(threshold, F.lit(5)).cast("string"))

    counted_ids = brute_force & (source.eqNullSafe("windows") | generic)
    counted_words = generic & ~has_ids & has_words & threshold.isNotNull()
    return F.struct(
        F.when((source == "apache") & has_words, query)
        .when(has_ids & (generic | (source == "windows")), by_id)
        .when(generic & has_words, fields).otherwise(words).alias("selection"),
        F.when(source == "auth", "keywords")
        .when(counted_ids & (source == "windows"), over("SourceAddress"))
        .when(counted_ids | counted_words, over("src_ip")).otherwise("selection").alias("condition"),
        F.when(counted_ids, "5m").when(counted_words, "10m").alias("timeframe"),
    )


def search_kind() -> Column:
    """Which search a finding gets, by log type, presence of event ids and rule name."""
    name, has_ids = F.col("rule_name"), F.size(F.coalesce("event_ids", F.array().cast("array<int>"))) > 0
    chain = F.when(F.lit(False), "")
    for types, needs_ids, holds, lacks, kind in fixed.SEARCH_CHOICE:
        fits = F.col("log_type").isin(types) & name.contains(holds)
        if needs_ids is not None:
            fits = fits & (has_ids == F.lit(needs_ids))
        if lacks:
            fits = fits & ~name.contains(lacks)
        chain = chain.when(fits, kind)
    return chain.otherwise("fallback")


def search_text(day: Column) -> Column:
    """Header, search and alert notes of a finding as one text."""
    template = _lookup({k: F.lit(v) for k, v in fixed.SEARCH_TEXTS.items()}, search_kind(), F.lit(""))

    def ids(name: str) -> Column:
        return F.array_join(F.transform("event_ids", lambda i: F.concat(F.lit(f"{name}="), i.cast("string"))), " OR ")

    default = F.when(F.col("rule_name").contains("block_deny_surge"), 10).when(
        F.col("rule_name").contains("error_status_spike"), 20
    ).otherwise(5)
    sourcetype = _lookup({k: F.lit(v) for k, v in fixed.SOURCETYPES.items()}, F.col("log_type"), F.lit(fixed.DEFAULT_SOURCETYPE))
    search = template
    for mark, value in {
        "{threshold}": F.coalesce("evidence.threshold", default).cast("string"),
        "{event_codes}": ids("EventCode"), "{event_ids}": ids("EventID"),
        "{sourcetype}": sourcetype, "{rule_name}": F.col("rule_name"),
    }.items():
        search = F.replace(search, F.lit(mark), value)
    level, mitre, title = F.upper("severity"), F.coalesce("mitre_technique", F.lit("Unknown")), F.col("title")
    return F.concat(
        F.lit(f"| *** {AUTHOR} Auto-Generated Splunk Search ***\n| *** Rule: "), title,
        F.lit("\n| *** Severity: "), level, F.lit("\n| *** MITRE: "), mitre,
        F.lit("\n| *** Generated: "), day, F.lit("\n\n"), search,
        F.lit(f"\n\n| *** === Alert Configuration ===\n| *** Alert Name     : {AUTHOR} - "), title,
        F.lit("\n| *** Cron Schedule  : */15 * * * *  (every 15 minutes)\n| *** Severity       : "), level,
        F.lit("\n| *** Risk Score     : "), text.risk_score(F.col("severity")).cast("string"),
        F.lit("/10\n| *** MITRE ATT&CK   : "), mitre,
        F.lit("\n| *** Throttle       : 1 alert per source per 1 hour\n" + fixed.ALERT_CLOSING),
    )


def sigma_rule(day: Column) -> Column:
    """The portable rule of a finding as one struct."""
    return F.struct(
        F.col("title"), rule_id(F.col("scope"), F.col("rule_name")).alias("id"),
        F.lit("experimental").alias("status"), F.col("description"),
        F.array(
            F.concat(F.lit("https://attack.mitre.org/techniques/"), text.technique_path(F.col("mitre_technique"))),
            F.lit("https://github.com/SigmaHQ/sigma"),
        ).alias("references"),
        F.lit(f"{AUTHOR} Auto-Generated").alias("author"), day.alias("date"),
        text.technique_tags(F.col("mitre_technique")).alias("tags"),
        log_source(F.col("log_type")).alias("logsource"), detection().alias("detection"),
        false_positives(F.col("rule_name")).alias("falsepositives"), F.col("severity").alias("level"),
    )


def _day(day: str | None) -> Column:
    return F.lit(day or datetime.date.today().isoformat())


def sigma_rules(findings: DataFrame, day: str | None = None) -> DataFrame:
    """One portable rule per finding, as a struct column."""
    return findings.select("scope", "log_type", "rule_name", sigma_rule(_day(day)).alias("rule"))


def splunk_searches(findings: DataFrame, day: str | None = None) -> DataFrame:
    """One search text per finding and the kind of search it is."""
    return findings.select(
        "scope", "log_type", "rule_name", search_kind().alias("search"), search_text(_day(day)).alias("body")
    )


def rules_table(findings: DataFrame, formats: str = "sigma", day: str | None = None) -> DataFrame:
    """``(scope, log_type, rule_name, format, body)`` for ``sigma``, ``splunk`` or ``both``.

    Findings are computed once and spread over the formats."""
    wanted = ["sigma", "splunk"] if formats == "both" else [formats]
    spread = findings.withColumn("format", F.explode(F.array(*[F.lit(f) for f in wanted])))
    body = F.when(F.col("format") == "sigma", numbered(F.to_json(sigma_rule(_day(day))))).otherwise(search_text(_day(day)))
    return spread.select("scope", "log_type", "rule_name", "format", body.alias("body"))


def numbered(body: Column) -> Column:
    """Event ids of a rule text as numbers: one id bare, several as a list."""
    ids = F.regexp_extract(body, r'"EventID":\[("\d+"(?:,"\d+")*)\]', 1)
    bare = F.replace(ids, F.lit('"'), F.lit(""))
    value = F.when(F.instr(bare, ",") > 0, F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)
    return F.when(ids == "", body).otherwise(F.replace(
        body, F.concat(F.lit('"EventID":['), ids, F.lit("]")), F.concat(F.lit('"EventID":'), value)))


def write_rule_texts(rules: DataFrame, path: str) -> None:
    """Rule bodies as text files under ``format=…/rule_name=…``, an empty line after each."""
    rules.select("format", "rule_name", F.col("body").alias("value")).write.mode("overwrite").partitionBy(
        "format", "rule_name").option("lineSep", "\n\n").text(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules as text rows under ``format=…/rule_name=…``; a new run replaces the old."""
    rules.write.mode("overwrite").partitionBy("format", "rule_name").parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").partitionBy("log_type").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """The canonical events, partitioned by log type so that each rule family reads only
    its own part and flag filters reach the scan."""
    events.write.mode("overwrite").partitionBy("log_type").parquet(path)


BUCKETS = 64


def replace_scopes(rows: DataFrame, path: str, scopes: DataFrame | None = None, by: tuple[str, ...] = ("log_type",),
                   scope: str = "scope", buckets: int = BUCKETS) -> None:
    """Rows of a run into a table that keeps the rows of all scopes the run did not read.

    ``scopes`` names what the run read, also where nothing was found (by default the scopes in
    ``rows``): their old rows go, those of other scopes stay. The table lies under
    ``bucket=…`` of the scope's hash and then ``by``; only buckets that hold one of the scopes are
    read and written. A run that is repeated leaves the same table; one that was cut off is put
    right by repeating it.
    """
    spark = rows.sparkSession
    hashed = F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")
    read = written((rows if scopes is None else scopes).select(scope).distinct().withColumn("bucket", hashed), "scopes")
    touched = sorted(r["bucket"] for r in read.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    new = rows.withColumn("bucket", hashed)
    files = spark._jvm.org.apache.hadoop.fs
    root = files.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = system.exists(root) and any(s.getPath().getName().startswith("bucket=") for s in system.listStatus(root))
    stale = []
    if there:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        kept = written(old.join(read.select(scope), scope, "left_anti").select(new.columns), "kept-scopes")
        stale = [tuple(r) for r in old.select("bucket", *by).distinct().collect()]  # folders, as many as the table has
        new = written(new.unionByName(kept), "new-scopes")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", *by).parquet(path)
    if stale:
        full = {tuple(r) for r in new.select("bucket", *by).distinct().collect()}
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for gone in set(stale) - full:
            parts = [f"{c}={escaped.escapePathName(str(v)) if v is not None else '__HIVE_DEFAULT_PARTITION__'}" for c, v in zip(("bucket", *by), gone)]
            system.delete(files.Path("/".join([path, *parts])), True)


def read_scopes(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """What ``replace_scopes`` has stored; a table that may be empty needs its schema."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).drop("bucket")
