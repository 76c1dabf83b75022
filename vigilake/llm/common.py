"""What several operators share: table access, work sizes, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.session import shared_path, written

__all__ = ["BLANKS", "LOWER", "WORD", "documents", "exactly", "free", "partitions", "shared_path", "table", "words_of", "written"]

#: A word is a run of anything but the six ASCII blanks; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z only, for ``bytes.translate``.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle of the session has; it is set with the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def exactly(name: str) -> Column:
    """A column by its full name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
