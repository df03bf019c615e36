"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: Sequence[DataFrame], weights: Sequence[float], k: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """doc_id, score: the sum of weight / (k + rank) over lists (rank, doc_id). by: columns that tell several queries apart."""
    parts = [df.select(*by, "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for df, w in zip(lists, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = scored.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")
