"""Substring dedup: MinHash banding over paragraphs, and exact runs of words that lie anywhere in a text.

Paragraphs. The blocks between blank lines, or the lines of a text without any; neighbours of fewer than 51 words are
taken together until they have as many. Each has a MinHash signature over its 5-word shingles, cut into bands; ``tuned``
chooses bands and rows so that a pair of similarity 0.75 shares a band with a probability of 0.99 at least. Paragraphs
that collide in a band are joined, exact Jaccard similarities of whole shingle sets are computed, and components of the
links (0.75 or more) are clusters. In clusters that touch several documents every paragraph but the first is a removal.

Runs. A passage may begin and end inside paragraphs that differ otherwise. Every run of 51 words that two documents
share is found, and so is every word of it:

1. Of the hashes of the 40-word grams of a text, the least of each 12 that follow one another is a seed (the last one of
   equals), so seeds depend on the text alone and touch each other. A shared run of 51 words holds 12 grams, so
   both documents have the same seed in it, in periodic text too.
2. Seeds that several documents hold are repeated. Where all documents with a seed agree on the seed before it and on its
   distance, the run goes on to that one. Where they don't, or the text begins, the run ends somewhere before the next
   common seed: there all of them show the 11 grams that could still belong to it (likewise after a seed), and
   those that several documents show are repeated.

Each place of a repeated gram but the first (by doc_id, then place) is a removal. Grams and paragraphs that overlap or
touch in a document are joined to spans; spans of fewer than 51 words are left out.

Rows: rows without doc_id or text have no paragraphs; rows with equal doc_id are one document, whose equal
runs are told apart by place alone. Texts of fewer than 40 words have none. Documents without repeats have
no rows in the result, nor has an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import keycounts, ngram_join
from quarry.llm.bytewords import U64, Texts, alone, chunks, mix, powers, shingle_hashes
from quarry.llm.common import cut, forget


def tuned(percent: int, recall: float, most: int = 10) -> tuple[int, int]:
    """Bands and rows of a band. Of all with ``most`` bands or fewer that let a pair of this similarity collide with this
    probability, those with the most rows, as they let other pairs collide least."""
    found = [(math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)), rows) for rows in range(1, 17)]
    return max((x for x in found if x[0] <= most), key=lambda x: x[1])


@dataclass(frozen=True)
class Paragraphs:
    """run: words of a passage; words: words of a gram; shingle, percent: similarity of paragraphs; recall: of banding."""

    run: int = 51
    words: int = 40
    shingle: int = 5
    percent: int = 75
    recall: float = 0.99

    @property
    def reach(self) -> int:
        return self.run - self.words + 1

    @property
    def bands(self) -> tuple[int, int]:
        return tuned(self.percent, self.recall)


NONE = U64(0xFFFFFFFFFFFFFFFF)
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def least_of(g: np.ndarray, size: int) -> np.ndarray:
    """The place of the least of each ``size`` values that follow one another; of equals the last."""
    at, wide = np.arange(len(g)), 1
    while wide < size and len(at):
        step = min(wide, size - wide)
        a, b = at[:-step], at[step:]
        at, wide = np.where(g[b] <= g[a], b, a), wide + step
    return at


class Found:
    """The words of some texts, the hash of the gram at each word (NONE where the text ends too soon), the number of the
    text of each word, and the first word of each text."""

    def __init__(self, texts: list[bytes], how: Paragraphs):
        self.t, self.how = Texts(texts, lower=True), how
        self.hashes, self.first = self.t.hashes(), self.t.first
        self.text = np.repeat(np.arange(len(texts)), self.t.counts)
        n = len(self.hashes)
        self.grams, k = np.full(n, NONE, dtype=U64), n - how.words + 1
        if k > 0:
            up, down = powers(n + 1)
            sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(self.hashes * up[:n], dtype=U64)])
            inside = self.text[:k] == self.text[how.words - 1:]
            self.grams[:k] = np.where(inside, np.minimum(mix((sums[how.words:] - sums[:k]) * down[:k]), NONE - U64(1)), NONE)

    def seeds(self) -> np.ndarray:
        """Places of the seeds. Only windows of grams of one text choose, so no other text has a say."""
        reach, chosen = self.how.reach, np.zeros(len(self.grams), dtype=bool)
        if len(self.grams) >= reach:
            last = slice(reach - 1, None)
            full = (self.grams[last] != NONE) & (self.text[last] == self.text[:len(self.grams) - reach + 1])
            chosen[least_of(self.grams, reach)[full]] = True
        grams = self.t.counts - self.how.words + 1
        for i in np.flatnonzero((grams > 0) & (grams < reach)).tolist():
            own = self.grams[self.first[i]:self.first[i] + grams[i]]
            chosen[self.first[i] + len(own) - 1 - int(own[::-1].argmin())] = True
        return np.flatnonzero(chosen)

    def points(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of the words ``first`` and end of the words ``last`` in their texts, in code points."""
        points = np.concatenate([[0], np.cumsum((self.t.buf & 0xC0) != 0x80)])
        base = points[self.t.at][self.text[first]]
        return points[self.t.starts[first]] - base, points[self.t.ends[last]] - base

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of each paragraph."""
        n = len(self.hashes)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lines = np.diff(np.searchsorted(np.flatnonzero(self.t.buf == 10), self.t.starts), prepend=0)  # line feeds before each word
        begins = np.diff(self.text, prepend=-1) != 0
        blank = np.zeros(len(self.t.counts), dtype=bool)
        blank[self.text[~begins & (lines >= 2)]] = True
        piece = np.flatnonzero(begins | (lines >= np.where(blank[self.text], 2, 1)))
        sizes = np.diff(np.append(piece, n))
        out, held, at, before = [], 0, 0, -1
        for a, size, text in zip(piece.tolist(), sizes.tolist(), self.text[piece].tolist()):
            if text != before:
                held, before = 0, text
            if size >= self.how.run or not held:
                at, held = a, 0
            held += size
            if held >= self.how.run:
                out.append((at, a + size))
                held = 0
        return tuple(np.array(out, dtype=np.int64).reshape(-1, 2).T)

    def signatures(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that name the shingles of each paragraph, and the keys of its bands (a row for each)."""
        bands, rows = self.how.bands
        if not len(start):
            return np.zeros((0, 2), dtype=U64), np.zeros((0, bands), dtype=U64)
        s = np.append(shingle_hashes(self.hashes, self.how.shingle), U64(0))
        ranges = np.stack([start, end - self.how.shingle + 1], axis=1).ravel()
        of = lambda f, x: f.reduceat(x, ranges)[::2]
        named = np.stack([of(np.add, mix(s)), of(np.add, mix(s ^ _Q))], axis=1)
        keys = np.zeros((len(start), bands), dtype=U64)
        for b in range(bands):
            for r in range(rows):
                k = b * rows + r
                turn, odd = mix(np.array([2 * k + 1, 2 * k + 2], dtype=U64))
                keys[:, b] = mix((keys[:, b] + of(np.minimum, (s ^ turn) * (odd | U64(1)))) * _P + U64(k + 1))
        return named, keys


Batches = Iterable[pa.RecordBatch]


def _found(batch: pa.RecordBatch, how: Paragraphs) -> Iterator[tuple[slice, Found]]:
    texts = batch.column(1).cast(pa.binary()).fill_null(b"")
    for a, b in chunks(pc.binary_length(texts).to_numpy(), 1 << 20):
        yield slice(a, b), Found(texts.slice(a, b - a).to_pylist(), how)


#: What is told of some texts together: arrays as bytes. Of seeds: doc (number in docs), gram, word. Of paragraphs: doc,
#: two names, first word, end, first and last code point, bands. base: the number of the first paragraph.
_ARRAYS = {"docs": "<i8", "seed_doc": "<i4", "seed": "<u8", "seed_at": "<i4", "para_doc": "<i4", "para_name": "<u8", "para_at": "<i4", "bands": "<u8"}
CHUNK = "seeds long, paras long, base long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def _chunks(how: Paragraphs) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        alone("substring")
        base = TaskContext.get().partitionId() << 36  # the rows are written once, and numbers stay
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, found in _found(batch, how):
                seeds = found.seeds()
                start, end = found.paragraphs()
                named, bands = found.signatures(start, end)
                doc = found.text[start] if len(start) else start
                first = found.first[doc] if len(start) else start
                points = found.points(start, end - 1) if len(start) else (start, start)
                arrays = (ids[rows], found.text[seeds], found.grams[seeds], seeds - found.first[found.text[seeds]], doc, named, np.stack([start - first, end - first, *points], axis=1), bands)
                blobs = [np.ascontiguousarray(x, dtype=kind).tobytes() for x, kind in zip(arrays, _ARRAYS.values())]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(seeds), len(start), base, *blobs)], names=[c.split()[0] for c in CHUNK.split(", ")])
                base += len(start)

    return run


def _arrays(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each row of a batch with some of the columns of CHUNK."""
    names = batch.schema.names
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        yield {c: np.frombuffer(x, dtype=_ARRAYS[c]) if c in _ARRAYS else x for c, x in zip(names, row)}


def _seed_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in _arrays(batch):
        # a key counts once in a text: repeats inside it are none between documents
        _, one = np.unique(mix(x["seed"] ^ mix(x["seed_doc"].astype(U64))), return_index=True)
        yield x["seed"][one].astype(U64)


def _band_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in _arrays(batch):
        yield x["bands"].astype(U64)


def _repeated(chunked: DataFrame, count: str, columns: list[str], keys_of, each: int = 1) -> tuple[object, int]:
    """The broadcast bitmap of the keys that occur twice, and its width."""
    n = each * int(chunked.agg(F.sum(count)).first()[0] or 0)
    parts, width = keycounts.parts_for(n), keycounts.bits_for(n)
    bitmap = keycounts.twice(chunked.select(*columns).mapInArrow(keycounts.packing(keys_of, parts), keycounts.PACKED), parts, width)
    return chunked.sparkSession.sparkContext.broadcast(bitmap), width


#: Seeds that may be repeated: key, the seeds before and after and their distances (0: the text's edge).
SEED = "key long, doc_id long, w0 int, before long, after long"


def _seed_rows(repeated, width: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(repeated.value, dtype=np.uint8)
        for batch in batches:
            for x in _arrays(batch):
                key, doc, at = x["seed"].astype(U64), x["seed_doc"], x["seed_at"].astype(np.int64)
                hit = np.flatnonzero(keycounts.has(bitmap, width, key))
                if not len(hit):
                    continue
                near = (doc[1:] == doc[:-1])
                step = np.diff(at).astype(U64) * _Q
                before, after = np.zeros(len(key), dtype=U64), np.zeros(len(key), dtype=U64)
                before[1:], after[:-1] = np.where(near, mix(key[:-1] + step) | U64(1), 0), np.where(near, mix(key[1:] + step) | U64(1), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[hit].view(np.int64)), pa.array(x["docs"][doc[hit]]), pa.array(at[hit].astype(np.int32)), pa.array(before[hit].view(np.int64)), pa.array(after[hit].view(np.int64))],
                    names=[c.split()[0] for c in SEED.split(", ")])

    return run


PARA = "id long, doc_id long, w0 int, w1 int, start int, end int, cls long, cls2 long, bands array<long>"


def _para_rows(repeated, width: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Paragraphs with a band that may be another's."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(repeated.value, dtype=np.uint8)
        for batch in batches:
            for x in _arrays(batch):
                n = len(x["para_doc"])
                if not n:
                    continue
                bands = x["bands"].astype(U64).reshape(n, -1)
                hit = np.flatnonzero(keycounts.has(bitmap, width, bands).any(axis=1))
                at, named = x["para_at"].reshape(n, 4)[hit], x["para_name"].view(np.int64).reshape(n, 2)[hit]
                offsets = pa.array(np.arange(len(hit) + 1, dtype=np.int32) * bands.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(bands[hit].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["base"] + hit), pa.array(x["docs"][x["para_doc"][hit]]), *(pa.array(np.ascontiguousarray(at[:, k])) for k in range(4)), *(pa.array(np.ascontiguousarray(named[:, k])) for k in range(2)), lists],
                    names=[c.split()[0] for c in PARA.split(", ")])

    return run


def _several(rows: DataFrame, key: str, *more) -> DataFrame:
    """For each value of ``key`` in several documents: its first place (doc_id, w0), and ``more`` aggregates.

    Written, so that a join with it begins with exchanges of both sides, which Spark can split where a key is frequent.
    """
    found = rows.groupBy(key).agg(F.min(F.struct("doc_id", "w0")).alias("first"), F.max("doc_id").alias("last"), *more)
    return cut(found.where("first.doc_id <> last").drop("last"))


_REMOVED = "(doc_id <> first.doc_id or w0 <> first.w0) as removed"


def _repeated_seeds(seeds: DataFrame) -> DataFrame:
    """doc_id, w0, key, first_doc, removed, before, after (whether the run may end before or after the seed)."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("lo", F.min), ("hi", F.max))]
    held = seeds.join(_several(seeds, "key", *ends), "key")
    return held.selectExpr("doc_id", "w0", "key", "first.doc_id as first_doc", _REMOVED,
                           "before = 0 or before_lo <> before_hi as before", "after = 0 or after_lo <> after_hi as after")


SEEDS = "array<struct<w0:int,key:bigint,first_doc:bigint,removed:boolean,before:boolean,after:boolean>>"
PARAS = "array<struct<id:bigint,w0:int,w1:int>>"
#: What texts show: kind 0, spans of repeated seeds; 1, grams where runs may end (key); 2, sets of paragraphs.
SHOWN = "kind int, doc_id long, w0 int, w1 int, start int, end int, removed boolean, first_doc long, key long, id long, n long, wide array<long>, set binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def _shown(count: int, kind: int, /, **columns: pa.Array) -> pa.RecordBatch:
    kinds = dict(c.split() for c in SHOWN.split(", "))
    columns["kind"] = pa.array(np.full(count, kind, dtype=np.int32))
    return pa.RecordBatch.from_arrays([columns[c].cast(_KINDS[t]) if c in columns else pa.nulls(count, _KINDS[t]) for c, t in kinds.items()], names=list(kinds))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each struct in some lists, and the fields of all."""
    rows, values = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    return rows, {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}


def _seed_spans(found: Found, row: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """row, first word, end (in the buffer), removed, first_doc of the seeds joined where they touch."""
    at, size = found.first[row] + s["w0"], found.how.words
    by = np.lexsort((at, s["removed"], row))
    row, at, removed, first = row[by], at[by], s["removed"][by], s["first_doc"][by]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (removed[1:] != removed[:-1]) | (at[1:] > at[:-1] + size)])
    starts = np.flatnonzero(new)
    return row[starts], at[starts], at[np.append(starts[1:], len(at)) - 1] + size, removed[starts], np.minimum.reduceat(first, starts)


def _ends(found: Found, row: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """Places of the grams at which a run of these seeds may begin or end."""
    at, out = found.first[row] + s["w0"], []
    for sign, on in ((-1, s["before"].astype(bool)), (1, s["after"].astype(bool))):
        p = (at[on][:, None] + sign * np.arange(1, found.how.reach)[None, :]).ravel()
        of = np.repeat(row[on], found.how.reach - 1)
        p, of = p[(p >= 0) & (p < len(found.grams))], of[(p >= 0) & (p < len(found.grams))]
        out.append(p[(found.text[p] == of) & (found.grams[p] != NONE)])
    return np.unique(np.concatenate(out))


def _show(how: Paragraphs) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """SHOWN of texts (doc_id, text, seeds, paras)."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _found(batch, how):
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start).to_numpy()
                part = lambda c: batch.column(c).slice(rows.start, rows.stop - rows.start)  # noqa: E731, B023
                spanned = lambda row, a, b: dict(zip(
                    ("doc_id", "w0", "w1", "start", "end"), map(pa.array, (ids[row], a - found.first[row], b - found.first[row], *found.points(a, b - 1)))))  # noqa: B023
                row, s = _flat(part(2))
                if len(row):
                    # rows that share a doc_id may differ in their texts
                    at = found.first[row] + s["w0"]
                    own = np.flatnonzero((s["w0"] < found.t.counts[row]) & (found.grams[np.minimum(at, len(found.grams) - 1)].view(np.int64) == s["key"]))
                    row, s = row[own], {c: x[own] for c, x in s.items()}
                if len(row):
                    r, a, b, removed, first = _seed_spans(found, row, s)
                    yield _shown(len(r), 0, **spanned(r, a, b), removed=pa.array(removed.astype(bool)), first_doc=pa.array(first))
                    p = _ends(found, row, s)
                    yield _shown(len(p), 1, **spanned(found.text[p], p, p + how.words), key=pa.array(found.grams[p].view(np.int64)))
                row, s = _flat(part(3))
                own = np.flatnonzero(s["w1"] <= found.t.counts[row])
                if len(own):
                    shingles = shingle_hashes(found.hashes, how.shingle)
                    a, b = (found.first[row] + s[c] for c in ("w0", "w1"))
                    sets = [np.unique(shingles[a[i]:b[i] - how.shingle + 1]) for i in own.tolist()]
                    wide = [np.frombuffer(ngram_join.parity_bits(x, 64 * ngram_join.WIDE), dtype="<i8") for x in sets]
                    yield _shown(len(own), 2, id=pa.array(s["id"][own]), n=pa.array([len(x) for x in sets]), wide=pa.array(wide, pa.list_(pa.int64())), set=pa.array([x.tobytes() for x in sets], pa.binary()))

    return run


def _texts_of(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) joined with ``told`` (doc_id, ...). A bitmap keeps most other texts from being shuffled."""
    width = ngram_join.wanted_width(told.count())
    wanted = rows.sparkSession.sparkContext.broadcast(ngram_join.wanted_bits(told, "doc_id", width))

    @F.pandas_udf("boolean")
    def hit(at: pd.Series) -> pd.Series:
        return pd.Series(ngram_join.is_wanted(np.frombuffer(wanted.value, dtype=np.uint8), at.to_numpy()))

    return rows.where(hit(ngram_join.bit_of(F.col("doc_id"), width))).join(told, "doc_id")


PLACED = ("doc_id", "w0", "w1", "start", "end", "first_doc", "removed")


def repeated_paragraphs(docs: DataFrame, how: Paragraphs | None = None) -> DataFrame:
    """PLACED (words and code points from, to; the first document of the cluster) of repeated grams and paragraphs."""
    how, spark = how or Paragraphs(), docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunked = cut(rows.mapInArrow(_chunks(how), CHUNK))
    seed_bits = _repeated(chunked, "seeds", ["seed_doc", "seed"], _seed_keys)
    band_bits = _repeated(chunked, "paras", ["bands"], _band_keys, how.bands[0])
    seeds = cut(chunked.select("docs", "seed_doc", "seed", "seed_at").mapInArrow(_seed_rows(*seed_bits), SEED))
    paras = cut(chunked.select("base", "docs", "para_doc", "para_name", "para_at", "bands").mapInArrow(_para_rows(*band_bits), PARA))
    forget(chunked)

    classes = cut(paras.groupBy("cls", "cls2").agg(F.min("id").alias("rep")))
    named = cut(paras.join(classes, ["cls", "cls2"]).drop("cls", "cls2"))
    entries = named.where("id = rep").select("id", F.posexplode("bands").alias("nth", "token"))
    lists = cut(ngram_join.listed(entries))
    in_lists = named.join(lists.select("id").distinct(), "id", "left_semi")

    none = lambda kind, name: F.lit(None).cast(kind[6:-1]).alias(name)
    of_seeds = _repeated_seeds(seeds).select("doc_id", F.struct("w0", "key", "first_doc", "removed", "before", "after").alias("s"), none(PARAS, "p"))
    of_paras = in_lists.select("doc_id", none(SEEDS, "s"), F.struct("id", "w0", "w1").alias("p"))
    told = cut(of_seeds.unionByName(of_paras).groupBy("doc_id").agg(F.collect_set("s").cast(SEEDS).alias("seeds"), F.collect_set("p").cast(PARAS).alias("paras")))
    forget(seeds)
    shown = cut(_texts_of(rows, told).select("doc_id", "text", "seeds", "paras").mapInArrow(_show(how), SHOWN))
    forget(told)

    ends = shown.where("kind = 1").select("key", "doc_id", "w0", "w1", "start", "end")
    ends = ends.join(_several(ends, "key"), "key").selectExpr("doc_id", "w0", "w1", "start", "end", "first.doc_id as first_doc", _REMOVED)

    sets = shown.where("kind = 2").dropDuplicates(["id"]).select("id", "n", "wide", "set")
    lists = lists.join(sets.select("id", "n"), "id").withColumn("ell", F.lit(1))
    comps = ngram_join.connect(lists, sets, lambda pairs: ngram_join.confirmed(pairs, sets, how.percent), how.percent, early=1, reach=1)
    near = named.join(comps.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("cluster", F.coalesce("label", "rep"))
    near = near.join(_several(near, "cluster"), "cluster").selectExpr("doc_id", "w0", "w1", "start", "end", "first.doc_id as first_doc", _REMOVED)
    return shown.where("kind = 0").select(*PLACED).unionByName(ends).unionByName(near)


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with island: the number of the run of rows that overlap or touch, within ``keys``."""
    by = Window.partitionBy(*keys).orderBy("w0", "w1")
    new = (F.col("w0") > F.coalesce(F.max("w1").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    return rows.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def repeated_spans(docs: DataFrame, how: Paragraphs | None = None) -> DataFrame:
    """doc_id, start, end, removed, first_doc: spans of repeated text; those that aren't the first are removals.

    first_doc is the least document that holds the first place of one of the span's clusters.
    """
    how = how or Paragraphs()
    placed = _islands(repeated_paragraphs(docs, how).repartition("doc_id").distinct(), ["doc_id"])
    whole = Window.partitionBy("doc_id", "island")
    long = placed.withColumn("size", F.max("w1").over(whole) - F.min("w0").over(whole)).where(F.col("size") >= how.run).drop("island", "size")
    spans = _islands(long, ["doc_id", "removed"]).groupBy("doc_id", "removed", "island").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.min("first_doc").alias("first_doc"))
    return spans.select("doc_id", "start", "end", "removed", "first_doc")
