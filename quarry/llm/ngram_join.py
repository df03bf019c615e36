"""Jaccard self-join of word shingles with adaptive multi-match prefixes.

1. Texts become sets of 64-bit shingle hashes. Equal sets are one class (told by two 64-bit sums), named by its least
   doc_id; one of each goes on.
2. Document frequencies of all shingles are counted (``keycounts``) and told in bitmaps: which shingles occur twice at
   least, and which reach each of a row of frequencies, four times the one before. Their size follows the input, up to a
   bound. False hits cost time and change no result, since any order of shingles that all documents share is valid.
3. Shingles are ordered by (frequency level, hash). A set of n shingles that links with another shares at
   least a = ceil(0.75 n), so the first n - a + m of both hold m common ones. m grows with the estimated
   candidates of the prefix; pairs with fewer than the smaller m in common are never verified.
4. Candidates are joined on prefix shingles in rounds. The first rounds pair near neighbours in each list
   only; pairs inside a component found so far are skipped; the last round takes all that is left. Lists are counted
   with partial sums and joined by exchanges that Spark may split, and neighbours of a long list are sought in parts of it.
5. Each set has parity bitmaps, one of 512 bits that the last join compares and one of about as many bits as shingles.
   The bits in which two of them differ are no more than the shingles in which the sets differ, so pairs with too many
   are dropped without a loss. The sets of the rest are made again from the texts and compared whole.

Rows: fewer words than a shingle form one shingle; texts without words and null texts have an empty set and
link with nothing, as do rows without doc_id (their component is null). Repeated rows are copies; rows that share a
doc_id but not a text are one document, linked with whatever one of them is linked with. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import keycounts
from quarry.llm.bytewords import U64, Texts, alone, chunks, mix, shingle_hashes
from quarry.llm.common import cut, forget
from quarry.llm.components import components

#: Frequencies that part levels of shingles, and how many bits (as powers of two) fewer than the main bitmap theirs have.
OFTEN, FEWER = tuple(16 * 4**k for k in range(8)), 5


@dataclass(frozen=True)
class Jaccard:
    """words in a shingle; the least similarity in percent."""

    words: int = 5
    percent: int = 75


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = Texts(texts, lower=True)
    h = t.hashes()
    long = shingle_hashes(h, words)
    out = []
    for a, n in zip(t.first.tolist(), t.counts.tolist()):
        if n >= words:
            out.append(np.unique(long[a:a + n - words + 1]))
        elif n:
            out.append(mix(shingle_hashes(h[a:a + n], n) + U64(n)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


_OTHER = U64(0x94D049BB133111EB)


def set_class(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name a set."""
    one, two = (int((mix(x).sum(dtype=U64) + U64(len(s))).astype(np.int64)) for x in (s, s ^ _OTHER))
    return one, two


#: Bytes of texts that are made sets at once, and keys that are packed at once: a worker holds some 16 times the bytes, and
#: rows of packed keys stay small beside the regions of the executors' heaps.
BYTES_AT_ONCE, KEYS_AT_ONCE = 1 << 18, 1 << 19


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """doc_id and sets of a batch (doc_id, text), some rows at a time."""
    texts = batch.column(1).cast(pa.binary()).fill_null(b"")
    for a, b in chunks(pc.binary_length(texts).to_numpy(), BYTES_AT_ONCE):
        yield batch.column(0).slice(a, b - a), shingle_sets(texts.slice(a, b - a).to_pylist(), words)


def _binaries(arrays: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


Batches = Iterable[pa.RecordBatch]


SIGNED = "doc_id long, n long, cls long, cls2 long, bits binary, wide array<long>, part int, keys binary, twice binary, often array<binary>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
_COLUMNS = {c: _KINDS[kind] for c, kind in (x.split() for x in SIGNED.split(", "))}
_NAMES = list(_COLUMNS)


def _rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of SIGNED; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, kind)) for c, kind in _COLUMNS.items()], names=_NAMES)


#: Bits of the parity bitmap that the join itself compares, in longs.
WIDE = 8


def parity_bits(s: np.ndarray, width: int = 0) -> bytes:
    """The parity of the shingles at each of ``width`` places; by default 64 at least, about as many as shingles."""
    width = width or 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ; the longer one is folded first."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _sign(words: int, parts: int, most: int = KEYS_AT_ONCE) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A row for each document, and rows of packed shingle keys for each part; all are dealt by part."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        full, blobs = keycounts.packed(np.concatenate(held), parts)
        return _rows(len(full), part=pa.array(full, pa.int32()), keys=pa.array(blobs, pa.binary()))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        alone("ngram join")
        held, size, at = [], 0, 0
        for batch in batches:
            for ids, sets in _sets(batch, words):
                n, named = len(sets), [set_class(s) for s in sets]
                yield _rows(
                    n, doc_id=ids, n=pa.array([len(s) for s in sets], pa.int64()), cls=pa.array([x for x, _ in named], pa.int64()), cls2=pa.array([x for _, x in named], pa.int64()),
                    bits=pa.array([parity_bits(s) for s in sets], pa.binary()),
                    wide=pa.array([np.frombuffer(parity_bits(s, 64 * WIDE), dtype="<i8") for s in sets], pa.list_(pa.int64())), part=pa.array((np.arange(at, at + n) % parts).astype(np.int32)),
                )
                at += n
                held += sets
                size += sum(map(len, sets))
                if size >= most:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return run


def _count(parts: int, width: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Documents' rows as they are; bitmaps of each part's range of keys. A part's keys are in one partition."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            keyed = batch.column(_NAMES.index("keys")).is_valid()
            yield batch.filter(pc.invert(keyed))
            rows = batch.filter(keyed)
            for part, blob in zip(rows.column(_NAMES.index("part")).to_pylist(), rows.column(_NAMES.index("keys")).to_pylist()):
                held.setdefault(part, []).append(blob)
        for part in sorted(held):
            keys, counts = np.unique(np.concatenate([keycounts.unpacked(blob) for blob in held.pop(part)]), return_counts=True)
            often = [keycounts.part_bits(keys[counts >= n], part, parts, width - FEWER) for n in OFTEN]
            twice = keycounts.part_bits(keys[counts >= 2], part, parts, width)
            yield _rows(1, part=pa.array([part], pa.int32()), twice=pa.array([twice], pa.binary()), often=pa.array([often], pa.list_(pa.binary())))

    return run


def frequency_bitmaps(signed: DataFrame, parts: int, width: int) -> list[bytes]:
    """The bitmaps of shingles that occur twice, and of those that reach each frequency of OFTEN: 2^width bits, and a
    32nd of that each."""
    rows = signed.where("twice is not null").select("part", "twice", *[F.col("often")[k].alias(f"often{k}") for k in range(len(OFTEN))]).toArrow()
    return [keycounts.whole(rows, "twice", parts, width), *(keycounts.whole(rows, f"often{k}", parts, width - FEWER) for k in range(len(OFTEN)))]


def multiplicity(cost: float, n: int, least: int) -> int:
    """How many common prefix shingles are asked for: more where lists are long, never more than a link has."""
    mean = cost / max(n, 1)
    return max(1, min(least, 1 if mean < 4 else 2 if mean < 64 else 4 if mean < 1024 else 8))


def levels(often: list[np.ndarray], width: int, s: np.ndarray) -> np.ndarray:
    """How many of the frequencies of OFTEN each shingle reaches."""
    out, on = np.zeros(len(s), dtype=np.int64), np.arange(len(s))
    for bitmap in often:
        on = on[keycounts.has(bitmap, width, s[on]) == 1]
        if not len(on):
            break
        out[on] += 1
    return out


def _prefixes(words: int, percent: int, width: int, bitmaps) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """token, cls, n, nth, ell: prefix shingles that occur twice at least. A task tells a class once."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        twice, *often = (np.frombuffer(b, dtype=np.uint8) for b in bitmaps.value)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sets in _sets(batch, words):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for s in sets:
                    n = len(s)
                    if not n or (cls := set_class(s)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(cls)
                    level = levels(often, width - FEWER, s)
                    if level.any():
                        by = np.argsort(level, kind="stable")
                        s, level = s[by], level[by]
                    least = -(-percent * n // 100)
                    one = n - least + 1
                    ell = multiplicity(float(np.where(level[:one] > 0, 4.0 ** (level[:one] + 1), 1).sum()), one, least)
                    s = s[:one + ell - 1]
                    nth = np.flatnonzero(keycounts.has(twice, width, s))
                    if len(nth):
                        for held, x in zip(out, (s[nth].view(np.int64), cls[0], n, nth, ell)):
                            held.append(x if isinstance(x, np.ndarray) else np.full(len(nth), x, dtype=np.int64))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "cls", "n", "nth", "ell"])

    return run


def wanted_bits(ids: DataFrame, column: str, width: int) -> bytes:
    """A bitmap of hashes of the values in ``column``: summed up by Spark, at most 8 MB."""
    bit = bit_of(F.col(column), width)
    cells = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << width - 6, dtype="<i8")
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return bitmap.tobytes()


def bit_of(value: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << width))


def is_wanted(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def wanted_width(rows: int) -> int:
    return max(16, min(26, max(rows, 1).bit_length() + 3))


def _set_rows(words: int, wanted) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """id, cls, cls2, set of the documents (doc_id, text, bit) whose bit is set."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            hit = batch.filter(pa.array(is_wanted(bitmap, batch.column(2).to_numpy())))
            for ids, sets in _sets(hit, words):
                named = [set_class(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([x for x, _ in named], pa.int64()), pa.array([x for _, x in named], pa.int64()), _binaries(sets)], names=["id", "cls", "cls2", "set"])

    return run


def _sets_of(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """id, set of the classes in ``pairs``, made again from one text of each. The texts are not shuffled: a bitmap
    tells which documents are wanted at all, a join which of those are."""
    spark = pairs.sparkSession
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    width = wanted_width(ids.count())
    wanted = spark.sparkContext.broadcast(wanted_bits(ids, "id", width))
    made = rows.select("doc_id", "text", bit_of(F.col("doc_id"), width).alias("bit")).mapInArrow(_set_rows(words, wanted), "id long, cls long, cls2 long, set binary")
    named = classes.join(ids, "id", "left_semi").select("id", "cls", "cls2")
    return made.join(named, ["id", "cls", "cls2"], "left_semi").dropDuplicates(["id", "cls", "cls2"]).select("id", "set")


def _near(percent: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Pairs whose parity bitmaps allow a link. Columns a, b, na, nb, bits of a, bits of b."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            # J >= p / 100 exactly if the sets differ in (100 - p) / (100 + p) of their sizes' sum at most
            keep = [
                (100 + percent) * differing_bits(x, y) <= (100 - percent) * n
                for x, y, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), sizes)
            ]
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["a", "b"])

    return run


def _verify(percent: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), dtype=U64), np.frombuffer(b.as_buffer(), dtype=U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, set) are alike enough, as u, v."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return cut(two.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "u long, v long").distinct())


def _linked(pairs: DataFrame, classes: DataFrame, rows: DataFrame, how: Jaccard) -> DataFrame:
    """The pairs (a, b) whose texts' sets are alike enough, as u, v."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits_" + x))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    near = cut(near.mapInArrow(_near(how.percent), "a long, b long"))
    sets = cut(_sets_of(near, classes, rows, how.words))
    found = confirmed(near, sets, how.percent)
    forget(near, sets)
    return found


def _fits(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


#: Entries of a list, about, among which neighbours are sought together.
STRETCH = 1000


def _neighbours(lists: DataFrame, reach: int, percent: int) -> DataFrame:
    """Pairs of entries at most ``reach`` apart in a list (in the order of a hash), of different components. Long lists
    are dealt out in stretches."""
    stretch = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / STRETCH))
    by = Window.partitionBy("token", "stretch").orderBy(F.xxhash64("token", "id"))
    near = F.array(*[F.lag(F.struct("id", "n", "comp"), k).over(by) for k in range(1, reach + 1)])
    pairs = lists.withColumn("stretch", stretch).select("id", "n", "comp", near.alias("near")).select("id", "n", "comp", F.explode("near").alias("o"))
    pairs = pairs.where("o is not null and o.comp <> comp").where(_fits("n", "o.n", percent))
    return pairs.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()


def _with_components(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """``lists`` with comp; lists that lie inside one component are left out."""
    known = lists.join(comps.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
    known = cut(known)
    several = cut(known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"))
    return known.join(several, "token", "left_semi")


def _all_pairs(lists: DataFrame, tested: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share enough prefix shingles and were not tested.

    wide: id, wide (parity bitmaps). Pairs that differ in more bits than a link can are not made.
    """
    lists = lists.join(wide.select("id", "wide"), "id")
    side = lambda x: lists.select(
        "token", F.col("id").alias(x), F.col("n").alias("n" + x), F.col("comp").alias("c" + x), F.col("ell").alias("l" + x), F.col("wide").alias("w" + x)
    )
    differ = " + ".join(f"bit_count(wa[{i}] ^ wb[{i}])" for i in range(WIDE))
    pairs = side("a").join(side("b"), "token").where("a < b and ca <> cb").where(_fits("na", "nb", percent)).where(
        f"{100 + percent} * ({differ}) <= {100 - percent} * (na + nb)")
    enough = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("la", "lb")).alias("l")).where("c >= l")
    return enough.select("a", "b").join(tested, ["a", "b"], "left_anti")


def listed(entries: DataFrame) -> DataFrame:
    """``entries`` (token, ...) of tokens with several, with c, their number. Counted by partial sums, written, and joined
    by exchanges that Spark can split, so no task has to hold the list of a frequent token."""
    counts = cut(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    return entries.join(counts, "token")


def connect(lists: DataFrame, wide: DataFrame, links: Callable[[DataFrame], DataFrame], percent: int, early: int, reach: int = 2) -> DataFrame:
    """node, label over the ids in lists (token, id, n, nth, ell, c): the components of the pairs that ``links`` confirms.

    early: entries with a smaller nth are paired first. wide: id, wide of each id.
    """
    as_edges = lambda c: c.select(F.col("node").alias("u"), F.col("label").alias("v"))
    first = cut(_neighbours(lists.where(F.col("nth") < early).withColumn("comp", F.col("id")), reach, percent))
    comps = cut(components(links(first)))
    second = cut(_neighbours(_with_components(lists, comps), reach, percent).join(first, ["a", "b"], "left_anti"))
    comps = cut(components(as_edges(comps).unionByName(links(second))))
    last = cut(_all_pairs(_with_components(lists, comps), first.unionByName(second), wide, percent))
    return cut(components(as_edges(comps).unionByName(links(last))))


def link_classes(spark: SparkSession, docs: DataFrame, how: Jaccard) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signed (doc_id, n, cls, cls2) of each row with an id; classes (id, cls, cls2, n); comps (node, label) over ids."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    about = int((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / 6)  # words
    parts, width = keycounts.parts_for(about), keycounts.bits_for(about)
    both = cut(rows.mapInArrow(_sign(how.words, parts), SIGNED).repartitionById(parts, "part").mapInArrow(_count(parts, width), SIGNED))
    bitmaps = spark.sparkContext.broadcast(frequency_bitmaps(both, parts, width))
    signed = both.where("twice is null").select("doc_id", "n", "cls", "cls2", "bits", "wide")
    first = lambda c: F.min(c).alias(c)
    classes = cut(signed.where("n > 0").groupBy("cls", "cls2").agg(F.min("doc_id").alias("id"), first("n"), first("bits"), first("wide")))

    prefixes = rows.mapInArrow(_prefixes(how.words, how.percent, width, bitmaps), "token long, cls long, n long, nth long, ell long")
    entries = cut(prefixes.dropDuplicates(["token", "cls"]))
    lists = cut(listed(entries).join(classes.select("cls", "id"), "cls").drop("cls"))
    forget(entries)
    comps = connect(lists, classes, lambda pairs: _linked(pairs, classes, rows, how), how.percent, early=4)
    forget(lists)
    return signed.drop("bits", "wide"), classes.select("id", "cls", "cls2", "n"), comps


def jaccard_components(docs: DataFrame, how: Jaccard | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for each row of ``docs``."""
    signed, classes, comps = link_classes(docs.sparkSession, docs, how or Jaccard())
    labels = comps.select(F.col("node").alias("id"), "label")
    of = cut(classes.join(labels, "id", "left").select("cls", "cls2", F.coalesce("label", "id").alias("component_id")))
    out = signed.where("n > 0").join(of, ["cls", "cls2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def first_of_groups(docs: DataFrame, how: Jaccard | None = None) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id, with all columns of ``docs``."""
    groups = jaccard_components(docs, how)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stay, F.col("doc_id") == F.col("__id"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
