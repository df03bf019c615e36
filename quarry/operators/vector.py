"""Vector search by cosine: exact, or in the cells nearest to the query."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """``v`` with length 1; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    scaled = F.transform(F.array(norm), lambda n: F.transform(v.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(x)))
    return scaled[0]


def rounded(x: Column, places: int) -> Column:
    """``x`` rounded as SQL does it: scaled, halves away from zero; what becomes zero keeps its sign."""
    scale = float(10**places)
    return F.signum(x) * (F.round(F.abs(x) * scale) / scale)


def _literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def topk(vectors: DataFrame, query: Sequence[float], k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """rank, doc_id, score (cosine): exact."""
    scored = vectors.select(F.col(key).alias("doc_id"), F.round(dot(l2_normalize(F.col(vec)), l2_normalize(_literal(query))), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


@dataclass(frozen=True)
class Cells:
    """centroids: at most 1024 vectors, on the driver; vectors: the input with its cell."""

    centroids: list[list[float]]
    vectors: DataFrame

    def write(self, path: str) -> None:
        """Parquet by cell, so a search reads the cells it probes."""
        self.vectors.write.partitionBy("cell").parquet(path)


def build(vectors: DataFrame, nlist: int | None = None, sample: int = 200_000, seed: int = 42, vec: str = "embedding") -> Cells:
    """k-means cells of normalised vectors, trained on a bounded sample. Every vector gets a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    nlist = nlist or max(1, min(1024, n // 39))
    unit = vectors.withColumn("__v", array_to_vector(l2_normalize(F.col(vec))))
    train = unit if n <= sample else unit.sample(sample / n, seed)
    model = KMeans(k=nlist, seed=seed, featuresCol="__v", predictionCol="cell", maxIter=10).fit(train)
    return Cells([list(map(float, c)) for c in model.clusterCenters()], model.transform(unit).drop("__v"))


def topk_cells(cells: Cells, query: Sequence[float], k: int, nprobe: int = 64, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """As ``topk``, over the ``nprobe`` cells nearest to the query. Cells are chosen on the driver, so they are literals of the scan."""
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    unit = [x / norm for x in query]
    far = [sum((a - b) ** 2 for a, b in zip(c, unit)) for c in cells.centroids]
    probed = sorted(range(len(far)), key=lambda i: (far[i], i))[:nprobe]
    return topk(cells.vectors.where(F.col("cell").isin(probed)), query, k, vec, key)


def index_for(vectors: DataFrame, least: int = 10_000, **how) -> Cells | None:
    """Cells for ``least`` vectors or more; fewer are searched exactly."""
    return build(vectors, **how) if vectors.count() >= least else None


def encoded(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "text", key: str = "doc_id", batch: int = 128, max_docs: int | None = None) -> DataFrame:
    """vec_id, embedding of documents (all, or the first by ``key``). ``encode`` gets ``batch`` texts at a time and gives a row for each."""
    rows = docs.select(F.col(key).cast("long").alias("vec_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows if max_docs is None else rows.orderBy("vec_id").limit(max_docs)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                own = b.iloc[at:at + batch]
                yield pd.DataFrame({"vec_id": own["vec_id"], "embedding": list(np.asarray(encode(own["text"].tolist()), dtype=np.float32))})

    return rows.mapInPandas(run, "vec_id long, embedding array<float>")


def _units(rows: Iterable) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=float) for r in rows])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m, where=norm > 0)


def _nearness(centroids: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Cells of each vector, the nearest first."""
    return np.argsort((centroids * centroids).sum(axis=1) - 2 * units @ centroids.T, axis=1, kind="stable")


def _best(vectors: DataFrame, queries: DataFrame, k: int, vec: str, key: str) -> DataFrame:
    """query_id, rank, doc_id, score: the best of each query over the vectors of its cells, by groups of bounded size."""
    vectors, queries = _parted(vectors, queries, key)
    on = ["cell", "slice", "block"]

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(v) and len(q):
            v = v.sort_values(key)
            ids, units, asked = v[key].to_numpy(), _units(v[vec]), q["query_id"].to_numpy()
            for a in range(0, len(q), 256):
                scores = np.round(_units(q["query_vector"].iloc[a:a + 256]) @ units.T, 6)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(asked[a:a + 256], best.shape[1]), "doc_id": ids[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    found = vectors.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


#: Vectors, and queries, of a group.
SLICE = 20_000


def _parted(vectors: DataFrame, queries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both with a slice and a block. A cell's vectors are dealt out to its slices and go to all its blocks, its queries
    the other way round, so that each pair meets once, and only large cells are split."""
    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias(name))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    cells = F.broadcast(parts(vectors, "slices").join(parts(queries, "blocks"), "cell"))  # a row for each centroid at most
    v = vectors.join(cells, "cell").withColumn("slice", F.pmod(F.xxhash64(key), F.col("slices"))).withColumn("block", each("blocks"))
    q = queries.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("slice", each("slices"))
    return v.drop("slices", "blocks"), q.drop("slices", "blocks")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, doc_id, score: exact, for each row (query_id, query_vector)."""
    one = F.lit(0).alias("cell")
    return _best(vectors.select(key, vec, one), queries.select("query_id", "query_vector", one), k, vec, key)


def neighbours_cells(cells: Cells, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 64, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """As ``neighbours``, over as many of the nearest cells as hold ``recall`` of the exact neighbours of ``sample`` queries."""
    centroids = np.array(cells.centroids)
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).toPandas()  # a few queries
    nprobe = len(centroids)
    if len(tried):
        some = queries.sparkSession.createDataFrame(tried, queries.schema)
        exact = neighbours(cells.vectors, some, k, vec, key)
        held = exact.join(cells.vectors.select(F.col(key).alias("doc_id"), "cell"), "doc_id").select("query_id", "cell").toPandas()
        order = dict(zip(tried["query_id"], np.argsort(_nearness(centroids, _units(tried["query_vector"])), axis=1)))
        at = np.sort([order[q][c] for q, c in zip(held["query_id"], held["cell"])])
        nprobe = int(at[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1

    def probes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = _nearness(centroids, _units(b["query_vector"]))[:, :nprobe]
                yield b.loc[b.index.repeat(nprobe)].assign(cell=near.ravel().astype(np.int32))

    asked = queries.select("query_id", "query_vector").mapInPandas(probes, "query_id long, query_vector array<double>, cell int")
    return _best(cells.vectors.select(key, vec, "cell"), asked, k, vec, key)
