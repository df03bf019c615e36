"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import delete, fresh_path, shared_dir

__all__ = ["SPACES", "WORDS", "cut", "delete", "forget", "fresh_path", "let", "n_words_of", "shared_dir", "table", "unit_hash", "words_of"]

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: a short lineage that outlives executors."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def forget(*tables: DataFrame | None) -> None:
    """Deletes what ``cut`` wrote, once nothing reads it any more."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df._cut_path)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words (long)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) that depends on the values of ``cols`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
