"""What the operators of this subpackage share: tables, scratch space, words."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discarded, written

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation.
materialize = written
#: Delete such a table once nothing reads it any more.
discard = discarded


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for a blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(col: str, folds: int, fold: int = 1) -> Column:
    """Whether the id's fold is the one kept away from training (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % folds == fold


#: Rows of a few numbers that may be broadcast: some 20 MB.
MOST_BROADCAST = 500_000


def if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table, to be broadcast if it is counted to hold no more than ``most`` rows; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it meet none of theirs."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int):
    """Jobs that run within it hand rows to the tasks' Python in batches of some ``most`` bytes (a larger row alone) instead of 64 MB,
    which either side holds more than once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
