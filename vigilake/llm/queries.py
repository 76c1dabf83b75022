"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crosstoken, fmindex, linededup, lloyd, maxent, mixing, quality, shards, simhash, suffixes, tokencount, windows
from .common import documents, table, written

MIX = {"keep": 0.5, "power": 0.5, "seed": "mix", "sweeps": 20}
TOKEN_MODEL = "piece_bpe_32k.model"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once; what is left of them is a few short columns
    rows = written(mixing.measured(documents(spark, sf_dir).select("doc_id", "text", "source", "lang")).drop("text", "source", "lang"), "measured")
    names = {"source": "source", "lang": "lang", "topic": "topic", "tokens": "n_tokens", "rate": "rate", "off": "off", "drawn": "drawn"}
    return mixing.rated(rows, **MIX).select("doc_id", *[F.col(f"__{k}").alias(v) for k, v in names.items()])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(documents(spark, sf_dir), whole=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKEN_MODEL))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).drop("kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    extra = spark.createDataFrame([(-1, None, record)], "conv_id long, turn long, record string")
    records = chat.turn_records(table(spark, sf_dir, "conversations")).union(extra)
    rows = chat.canonical(records, layouts=(*chat.LAYOUTS, chat.TURN), turn_col="turn").select("conv_id", "turn", "role", "text")
    done = chat.read_back(chat.formatted(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(documents(spark, sf_dir))


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.without_repeats(documents(spark, sf_dir)).drop("kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return crosstoken.alignment(documents(spark, sf_dir), *map(public_tokenizers.path, ALIGNED))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = lloyd.compressed(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_mixing, op3_lm_scoring, op4_token_counts, op5_suffix_dedup, op6_decontamination,
    op7_chat_formatting, op8_sharding, op9_window_dedup, op10_simhash, op11_token_alignment, op12_vector_codes, op13_line_dedup)}

#: Queries that SQL cannot express, and the test that compares each with a plain version.
NO_SQL = {
    "op1_quality_rules": "test_operators.test_quality", "op3_lm_scoring": "test_operators.test_language_model",
    "op4_token_counts": "test_operators.test_token_counts", "op5_suffix_dedup": "test_operators.test_suffixes",
    "op8_sharding": "test_operators.test_shards", "op10_simhash": "test_operators.test_simhash",
    "op11_token_alignment": "test_crosstoken.test_equals_plain", "pipeline": "test_pipeline.test_stages",
}

_SEEN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ABC = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_ABC}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op12_vector_codes": lloyd.digest_sql(),
    "op13_line_dedup": linededup.DIGEST_SQL,
    "op2_mixing": mixing.mix_sql(**MIX),
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
  b AS (SELECT item_id::VARCHAR AS item, {_PLAIN} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
         FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
  dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
  h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, s)),
  c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
  t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_chat_formatting": r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
  l AS (SELECT *, length(text) + length(role) + length(regexp_replace(text || role, '[^<\\[]', '', 'g')) + 23 AS n FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id""",
    "op9_window_dedup": f"""WITH d AS (SELECT doc_id, {_SEEN} AS w FROM documents),
  win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
  gone AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS m FROM win GROUP BY s) USING (s) WHERE m < doc_id),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
  last AS (SELECT words.doc_id, words.i, word, max(gone.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) AS g
           FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i),
  kept AS (SELECT doc_id, count(*) FILTER (i - g < 50) AS n, string_agg(word, ' ' ORDER BY i) FILTER (g IS NULL OR i - g >= 50) AS t FROM last GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
