"""A toxicity classifier with counterfactual regularisation.

Features are the words of a text and their beginnings (3 to 8 letters), hashed, each counted once. Those whose
rates differ between toxic and other labelled documents are kept, with those of all identity terms. A
logistic model with weights of 0 or more (harmless words don't excuse others) is trained on them. In every labelled
document that names a group, each identity term is swapped for another of its kind, and the squared change of the
document's score is a penalty, so that who is named moves no score.

Training reads ``most`` labelled documents at most (the bound is a parameter; they are those with the least
hash of doc_id), never those held out. They are written once and read twice: to count features, of which the driver gets
a row each, and to list the kept ones of each document. Scoring reads every whole text.

Rows: a null or empty text has no features and gets the score of the offset alone. Rows stand for
themselves; labels that are null or without a document are ignored, the greatest label of an id counts. With
no labels every score is 0.5 or below (the offset of an empty sample). An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import U64, chunks, hash_ranges, mix
from quarry.llm.common import cut, forget

BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)

# Terms for groups of people, swapped for each other within a line.
IDENTITY = (
    "women men girls boys mothers fathers daughters sons",
    "woman man girl boy mother father daughter son",
    "muslims christians jews hindus buddhists sikhs atheists catholics protestants",
    "muslim christian jewish hindu buddhist sikh atheist catholic protestant",
    "immigrants refugees foreigners migrants natives",
    "gay lesbian bisexual transgender straight queer",
    "black white asian latino african european american arab",
    "disabled deaf blind autistic elderly young",
    "femmes hommes filles garçons musulmans chrétiens juifs immigrés réfugiés",
    "frauen männer mädchen jungen muslime christen juden einwanderer flüchtlinge",
    "mujeres hombres chicas chicos musulmanes cristianos judíos inmigrantes refugiados",
)
_OTHERS = {term: group[i + 1:] + group[:i] for group in (line.split() for line in IDENTITY) for i, term in enumerate(group)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_OTHERS, key=len, reverse=True)) + r")\b")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def swap(text: str) -> str:
    """``text`` (lower case) with each identity term replaced by another of its kind, which the text itself chooses."""
    turn = zlib.crc32(text.encode("utf-8", "replace"))
    return _TERM.sub(lambda m: _OTHERS[m[1]][turn % len(_OTHERS[m[1]])], text)


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, feature), each once, by row. wanted: which features are told, all by default."""
    rows = [t.lower().encode("utf-8", "replace") for t in texts]
    data = b"\n".join(rows)
    buf = np.frombuffer(data, dtype=np.uint8)
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = _LETTER[buf]
    change = np.diff(edge)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.cumsum([0] + [len(r) + 1 for r in rows])
    row = np.searchsorted(at, starts, side="right") - 1
    # each different word is worked on once
    words, first, back = np.unique(hash_ranges(buf, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    kinds = [words] + [hash_ranges(buf, s, np.minimum(s + k, e)) * U64(3) + U64(k) for k in PREFIXES]
    table = (mix(np.stack(kinds)) >> U64(64 - BITS)).astype(np.int64)
    if wanted is not None:  # most words have none of them
        on = wanted[table].any(axis=0)[back]
        row, back = row[on], back[on]
    pairs = np.unique(row * len(words) + back)
    row, word = pairs // len(words), pairs % len(words)
    pairs = np.unique((row[None, :] << BITS) + table[:, word])
    row, feature = pairs >> BITS, pairs & ((1 << BITS) - 1)
    return (row, feature) if wanted is None else (row[wanted[feature]], feature[wanted[feature]])


def feature_lists(texts: list[str], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    row, feature = features(texts, wanted)
    return np.split(feature, np.searchsorted(row, np.arange(1, len(texts))))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of all features; 0 if not kept
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        row, feature = features(texts, self.weights != 0)
        z = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


SIZE = 1 << BITS


def chosen(seen: np.ndarray, yes: int, no: int, least_z: float = 2.5, least_docs: int = 4) -> np.ndarray:
    """Which features are kept. seen: how many of ``no`` harmless and of ``yes`` toxic documents have each."""
    p, q = (seen[1] + 0.5) / (yes + 1), (seen[0] + 0.5) / (no + 1)
    z = (p - q) / np.sqrt(p * (1 - p) / max(yes, 1) + q * (1 - q) / max(no, 1))
    keep = (np.abs(z) > least_z) & (seen.sum(axis=0) >= least_docs)
    for x in feature_lists(list(_OTHERS)):
        keep[x] = True
    return keep


def _logistic(z: float) -> float:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def swap_gradients(w: np.ndarray, offset: float, x: np.ndarray, other: np.ndarray, penalty: float) -> list[tuple[np.ndarray, float]]:
    """Features and what penalty * (score(x) - score(other))^2 grows by with the weight of each."""
    gone, new, both = np.setdiff1d(x, other), np.setdiff1d(other, x), np.intersect1d(x, other)
    one, two = _logistic(w[x].sum() + offset), _logistic(w[other].sum() + offset)
    change, a, b = 2 * penalty * (one - two), one * (1 - one), two * (1 - two)
    return [(gone, change * a), (new, -change * b), (both, change * (a - b))]


def fit(lists: list[np.ndarray], swapped: list[np.ndarray | None], labels: np.ndarray, penalty: float = 8.0, epochs: int = 10, seed: int = 0) -> Model:
    """Trains on lists of kept features. swapped: the features after swapping terms, or None where no group is named."""
    yes = int(labels.sum())
    if not yes or yes == len(labels):
        return Model(np.zeros(SIZE), -2.0 if not yes else 2.0)
    w, g2, offset, rng = np.zeros(SIZE), np.full(SIZE, 1e-2), -2.0, np.random.default_rng(seed)

    def step(x: np.ndarray, gradient: np.ndarray | float) -> None:
        g2[x] += gradient * gradient
        w[x] = np.maximum(w[x] - 0.2 * gradient / np.sqrt(g2[x]), 0)

    for _ in range(epochs):
        for i in rng.permutation(len(lists)).tolist():
            x = lists[i]
            error = _logistic(w[x].sum() + offset) - labels[i]
            step(x, error + 1e-3 * w[x])
            offset -= 0.02 * error
            if swapped[i] is not None:
                for own, gradient in swap_gradients(w, offset, x, swapped[i], penalty):
                    step(own, gradient)
    return Model(w, offset)


def held_out(doc_id: Column, fold: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % fold == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, label: str = "toxic") -> Model:
    """Fits on the documents (doc_id, text) of at most ``most`` labels (doc_id, toxic)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ``most`` ids at most; an id may have several rows
    read = cut(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", F.col("__label").alias("label"), "text"))

    def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[str]]]:
        texts = [(t or "").lower() for t in batch.column(2).to_pylist()]
        for a, b in chunks(np.array([len(t) for t in texts])):
            yield slice(a, b), texts[a:b]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SIZE), dtype=np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for rows, texts in texts_of(batch):
                row, feature = features(texts)
                toxic = label[rows][row] == 1
                seen[1] += np.bincount(feature[toxic], minlength=SIZE)
                seen[0] += np.bincount(feature[~toxic], minlength=SIZE)
        on = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(seen[0, on]), pa.array(seen[1, on])], names=["feature", "no", "yes"])

    told = read.mapInArrow(count, "feature long, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toArrow()
    seen = np.zeros((2, SIZE), dtype=np.int64)
    at = told.column("feature").to_numpy()
    seen[0, at], seen[1, at] = told.column("no").to_numpy(), told.column("yes").to_numpy()
    by = read.groupBy("label").count().collect()  # two rows
    yes, no = (sum(r["count"] for r in by if r["label"] == k) for k in (1, 0))
    keep = chosen(seen, yes, no)
    kept = docs.sparkSession.sparkContext.broadcast(keep)  # 2^18 flags

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda x: x.astype("<i4").tobytes()
        for batch in batches:
            for rows, texts in texts_of(batch):
                other = [swap(t) for t in texts]
                own, new = feature_lists(texts, kept.value), feature_lists(other, kept.value)
                cells = [batch.column(k).slice(rows.start, len(texts)) for k in (0, 1)]
                changed = [pack(n) if s != t else None for n, s, t in zip(new, other, texts)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([pack(x) for x in own], pa.binary()), pa.array(changed, pa.binary())], names=["doc_id", "label", "own", "new"])

    got = read.mapInArrow(lists, "doc_id long, label int, own binary, new binary").toPandas()
    forget(read)
    got = got.sort_values(["doc_id", "own"], kind="stable").head(most)
    unpack = lambda x: None if x is None else np.frombuffer(x, dtype="<i4").astype(np.int64)
    return fit([unpack(x) for x in got["own"]], [unpack(x) for x in got["new"]], got["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "") for t in batch.column(1).to_pylist()]
            parts = [given.value.scores(texts[a:b]) for a, b in chunks(np.array([len(t) for t in texts]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
