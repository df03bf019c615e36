"""The inverted index: postings, terms, document lengths and corpus statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf, dl), terms (term, df), doc_stats (doc_id, dl), stats (n, total_len, avgdl, vocab: one row).

    Postings carry their document's length, so a query reads nothing but the postings of its terms.
    """

    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    stats: DataFrame

    def persist(self) -> Index:
        for df in (self.postings, self.terms, self.doc_stats, self.stats):
            df.persist()
        return self

    def close(self) -> None:
        for df in (self.postings, self.terms, self.doc_stats, self.stats):
            df.unpersist()

    def write(self, path: str, partitions: int | None = None) -> None:
        """Parquet, sorted by term, so a filter on terms skips files and row groups."""
        n = partitions or int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term").sortWithinPartitions("term", "doc_id").write.option(
            "parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        self.terms.repartitionByRange(max(1, n // 4), "term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        self.doc_stats.write.parquet(f"{path}/doc_stats")
        self.stats.coalesce(1).write.parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "doc_stats", "stats")))


def tokenized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, tokens (lower case)."""
    return docs.select("doc_id", tokens(F.lower(F.col(text))).alias("tokens"))


def corpus_stats(doc_stats: DataFrame, terms: DataFrame) -> DataFrame:
    sums = doc_stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"))
    vocab = terms.agg(F.count(F.lit(1)).alias("vocab"))
    avg = F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(0.0)
    return sums.crossJoin(F.broadcast(vocab)).select("n", "total_len", avg.alias("avgdl"), "vocab")  # a row each


def segmented(text: Column, segment: Callable[[str], str]) -> Column:
    """``text`` with its words joined by a segmenter, in Arrow batches; a text on which it fails stays as it is."""
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else segment(t)
        except Exception:  # whatever the model raises
            return t

    @F.pandas_udf("string")
    def all_of(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return all_of(text)


def build(docs: DataFrame, text: str = "text", segment: Callable[[str], str] | None = None) -> Index:
    """Index of ``docs`` (doc_id, text). Documents without tokens count, with length 0."""
    if segment:
        docs = docs.withColumn(text, segmented(F.col(text), segment))
    cut = tokenized(docs, text)
    each = cut.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    postings = each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    docs_len = cut.select("doc_id", F.size("tokens").alias("dl"))
    return Index(postings, terms, docs_len, corpus_stats(docs_len, terms))


def merge(*parts: Index) -> Index:
    """One index of indexes over disjoint documents."""
    union = lambda name: (lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union_all(dfs[1:])))([getattr(p, name) for p in parts])

    def union_all(dfs: list[DataFrame]) -> DataFrame:
        return dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union_all(dfs[1:]))

    postings = union("postings")
    terms = union("terms").groupBy("term").agg(F.sum("df").alias("df"))
    docs = union("doc_stats")
    return Index(postings, terms, docs, corpus_stats(docs, terms))
