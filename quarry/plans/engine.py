"""The search engine: one object over an index, a vector table and a document table."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import bm25, fusion, results, vector
from quarry.operators.index import Index

_ID = re.compile(r"[\d\-.\s]{8,15}\Z")
#: The most hits of a search.
MOST = 2000
FIELDS = ("company_name", "tax_code", "address", "representative", "status", "industry")


@dataclass
class SearchEngine:
    """documents: doc_id, company_name, tax_code, address, representative, status, industry. encode: query to vector.

    Ties go to the lower doc_id. In hybrid mode boosts see the cut list unless ``boost_pool`` is larger.
    """

    index: Index
    documents: DataFrame
    vectors: DataFrame | None = None
    encode: Callable[[str], Sequence[float]] | None = None
    params: bm25.Params = field(default_factory=bm25.Params)
    boost_pool: int | None = None
    segment: bm25.Segmenter | None = None

    def _bm25(self, q: str, k: int) -> DataFrame:
        return bm25.topk(bm25.score(self.index, {0: q}, self.params, self.segment), k)

    def _vector(self, q: str, k: int) -> DataFrame:
        if self.vectors is None or self.encode is None:
            return self.documents.sparkSession.createDataFrame([], "rank int, doc_id long, score double")
        return vector.topk(self.vectors, self.encode(q), k)

    def hits(self, q: str, mode: str = "hybrid", top_k: int = 10, alpha: float = 0.65) -> DataFrame:
        """rank, doc_id, score before boosts."""
        pool = max(3 * top_k, 50)
        if mode == "bm25":
            return self._bm25(q, pool).withColumn("score", F.round("score", 4))
        if mode == "vector":
            return self._vector(q, pool).withColumn("score", F.round("score", 4))
        return fusion.ranked(fusion.rrf([self._bm25(q, pool), self._vector(q, pool)], [alpha, 1 - alpha]), max(top_k, self.boost_pool or 0))

    def search(self, q: str, mode: str = "hybrid", top_k: int = 10, alpha: float = 0.65) -> DataFrame:
        """rank, doc_id, score and the fields of the best documents; any other mode means hybrid."""
        if not 1 <= top_k <= MOST or not 0 <= alpha <= 1:
            raise ValueError("top_k is 1 to 2000, alpha 0 to 1")
        q = q.strip()
        if not q:
            return results.with_metadata(self.documents.sparkSession.createDataFrame([], "rank int, doc_id long, score double"), self.documents).select("rank", "doc_id", "score", *FIELDS)
        if _ID.match(q):
            found = results.find_id(self.documents, q).withColumns({"rank": F.lit(1), "score": F.lit(1.0), "doc_id": F.lit(-1).cast("long")})
            if not found.isEmpty():
                return found.select("rank", "doc_id", "score", *FIELDS)
        hits = results.with_metadata(self.hits(q, mode, top_k, alpha).drop("rank"), self.documents)
        boosted = results.boost(hits, q)
        best = boosted.orderBy(F.desc("score"), "doc_id").limit(top_k)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # ``top_k`` rows
        return best.select(rank.alias("rank"), "doc_id", "score", *FIELDS)

    def total(self, q: str, mode: str = "hybrid") -> DataFrame:
        """total: the hits that a search reports. Of vectors, which all match, as many as it returns at most."""
        return self._vector(q, MOST).agg(F.count(F.lit(1)).alias("total")) if mode == "vector" else self.match_count(q)

    def match_count(self, q: str) -> DataFrame:
        """Documents that hold a term of the query."""
        return bm25.score(self.index, {0: q}, self.params, self.segment).agg(F.count(F.lit(1)).alias("total"))

    def stats(self) -> DataFrame:
        return self.index.stats.select(
            F.col("n").alias("total_documents"), F.col("vocab").alias("vocabulary_size"), F.round("avgdl", 1).alias("avg_document_length"),
            F.lit(self.vectors is not None).alias("vector_index_loaded"))
