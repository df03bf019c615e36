"""BM25 with a coordination factor, for one query or many at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import PUNCTUATION
from quarry.operators.index import Index

Segmenter = Callable[[str], str]


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.4
    coord_exp: float = 1.5
    #: Terms in more than this share of documents are left out of queries with more than two terms.
    common: float = 0.8
    #: Postings of a term that are scored, by doc_id; all if None. Loses matches.
    cap: int | None = None


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def tf_part(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.4) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_tokens(query: str, segment: Segmenter | None = None) -> list[str]:
    """The distinct tokens of a query, in order: of its lower case, and with a segmenter of its variants."""
    clean = re.sub(r"[^\w\s]", " ", query)
    low = clean.lower()
    forms = [low] if segment is None else [segment(low), segment(clean.upper()).lower(), low.replace("_", " ")]
    found = [t for form in forms for t in form.split() if (len(t) > 1 or t.isdigit()) and not all(c in PUNCTUATION for c in t)]
    return list(dict.fromkeys(found))


def _query_terms(index: Index, queries: Mapping[int, str], params: Params, segment: Segmenter | None) -> DataFrame | None:
    """qid, term, idf, valid (terms of the query that count): small, a few rows for each query."""
    rows = [(q, t, len(ts)) for q, ts in ((q, query_tokens(x, segment)) for q, x in queries.items()) for t in ts]
    if not rows:
        return None
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame(rows, "qid int, term string, size int")
    # literals reach the scan of a stored index, so other row groups are skipped
    found = index.terms.where(F.col("term").isin(sorted({r[1] for r in rows}))).join(F.broadcast(wanted), "term")
    n = F.col("n")
    kept = found.crossJoin(F.broadcast(index.stats.select("n"))).where((F.col("size") <= 2) | (F.col("df") <= F.floor(n * params.common)))
    kept = kept.withColumn("idf", idf(F.col("df"), n)).where("idf > 0")
    return kept.select("qid", "term", "idf", F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("valid"))


EMPTY = "qid int, doc_id long, score double, matched long"


def score(index: Index, queries: Mapping[int, str], params: Params = Params(), segment: Segmenter | None = None) -> DataFrame:
    """qid, doc_id, score, matched of all documents with a term of a query."""
    spark = index.postings.sparkSession
    wanted = _query_terms(index, queries, params, segment)
    if wanted is None:
        return spark.createDataFrame([], EMPTY)
    terms = sorted({t for q in queries.values() for t in query_tokens(q, segment)})
    postings = index.postings.where(F.col("term").isin(terms))
    if params.cap is not None:
        rank = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
        postings = postings.withColumn("__r", rank).where(F.col("__r") <= params.cap).drop("__r")
    # the terms of given queries: a few rows for each query, whatever the corpus
    hits = postings.join(F.broadcast(wanted), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    part = F.col("idf") * tf_part(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("avgdl"), params.k1, params.b)
    summed = hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("matched"), F.max("valid").alias("valid"))
    total = F.col("s") * F.pow(F.col("matched") / F.col("valid"), F.lit(params.coord_exp))
    return summed.select("qid", "doc_id", F.round(total, 6).alias("score"), "matched")


def topk(scored: DataFrame, k: int) -> DataFrame:
    """rank, doc_id, score of the best of one query."""
    best = scored.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


def topk_each(scored: DataFrame, k: int) -> DataFrame:
    """qid, rank, doc_id, score of the best of each query."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scored.select("qid", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
