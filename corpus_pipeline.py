"""From raw documents to training shards: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again
before the next; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm import fmindex, mixing, quality, shards, simhash
from vigilake.llm.common import documents, table, written


#: Shingle length and bit distance of the near-duplicate operator.
NEAR = {"words": 3, "distance": 2}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules and the calibrated forest keep.

    Null, empty and very short texts fail the base rules. Rows without a label are judged like any
    other; without labels the forest rejects nothing. Repeated rows and equal ids are judged one by
    one and alike; an empty table gives no rows. Other columns stay as they are, whatever their names.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every class of the near-duplicate operator.

    Three-word shingles, links at two or fewer of 64 bits. Rows without id come last; of rows equal
    in id and text one stays; texts without words are one class; an empty table gives no rows.
    Other columns stay as they are, whatever their names.
    """
    return simhash.without_near_duplicates(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that benchmark items share; a text without a word left goes.

    Null and empty texts have no words and stay. Spans are cut from whole texts of any length;
    repeated rows are cut alike; an empty benchmark changes nothing and an empty table gives no rows.
    ``n_chars`` is counted anew; other columns stay as they are, whatever their names.
    """
    return fmindex.without_spans(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn so that the tokens of sources, languages and topics meet their targets, 0.8 of all.

    Null sources and languages count as empty ones. Texts without words carry no tokens and are not
    drawn. A draw follows from the id, so equal ids and repeated rows in one cell fall alike; an
    empty table gives no rows. Columns stay as they are, whatever their names.
    """
    return mixing.drawn_rows(docs, keep=0.8, power=0.7)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of about equal bytes, in the order of the ids (nulls first).

    Null and empty texts have size 1; repeated rows and equal ids are rows of their own and get
    slots of their own; a text longer than a shard's share leaves other shards empty; an empty
    table gives no rows. Input columns are carried, but for those named like a result column.
    """
    return shards.shards(docs, carry=tuple(docs.columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]
#: A forest and a majority of hash bits have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
