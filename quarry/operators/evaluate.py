"""Precision of ranked lists against keyword judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_relevant(text: Column, keywords: Column) -> Column:
    """Whether a keyword (lower case, ``_`` as a space) is in the text."""
    plain = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    return F.transform(F.array(plain(text)), lambda t: F.exists(keywords, lambda k: t.contains(plain(k))))[0]


def precision(judged: DataFrame, k: int = 10) -> DataFrame:
    """qid, engine, precision over what was returned of the first k. judged: qid, engine, rank, relevant."""
    return judged.where(F.col("rank") <= k).groupBy("qid", "engine").agg(F.round(F.avg(F.col("relevant").cast("double")), 6).alias("precision"))


def summary(precisions: DataFrame) -> DataFrame:
    return precisions.groupBy("engine").agg(
        F.round(F.avg("precision"), 6).alias("avg_precision"), F.min("precision").alias("min_precision"), F.max("precision").alias("max_precision"))


def winners(precisions: DataFrame, engines: tuple[str, str, str] = ("bm25", "vector", "hybrid")) -> DataFrame:
    """qid, winner: the engines with the best precision, comma-joined, "all" for all three; and hybrid_ok."""
    wide = precisions.groupBy("qid").agg(*[F.coalesce(F.max(F.when(F.col("engine") == e, F.col("precision"))), F.lit(0.0)).alias(e) for e in engines])
    best = F.greatest(*engines)
    won = F.filter(F.array(*[F.when(F.col(e) == best, F.lit(e)) for e in engines]), lambda x: x.isNotNull())
    return wide.select(
        "qid", F.when(F.size(won) == len(engines), "all").otherwise(F.array_join(won, ",")).alias("winner"),
        (F.col(engines[2]) >= F.greatest(*engines[:2])).alias("hybrid_ok"),
    )


def latency(times: DataFrame) -> DataFrame:
    """engine, avg_seconds, min_seconds, max_seconds. times: engine, seconds of each query."""
    f = lambda how, name: F.round(how("seconds"), 6).alias(name)
    return times.groupBy("engine").agg(f(F.avg, "avg_seconds"), f(F.min, "min_seconds"), f(F.max, "max_seconds"))


def win_counts(won: DataFrame) -> DataFrame:
    """winner, queries, hybrid_ok: how many queries each set of engines won, and in how many of them the third was as good."""
    return won.groupBy("winner").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.col("hybrid_ok").cast("long")).alias("hybrid_ok"))
