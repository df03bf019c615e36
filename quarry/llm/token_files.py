"""Token ids of documents in ORC files: integer run-length encoding, row indexes every few rows, Bloom
filters on the document id. A file holds a range of ids in ascending order, so stripes and files outside
a wanted range are skipped by their statistics, and stripes are read in parallel.

Rows: a null text counts as empty and gives the end id alone. Rows are ordered by doc_id (nulls first), then
text; repeated rows stay. An empty table gives no rows. Other columns of the input are ignored.

The tokenizers library encodes. A piece between single spaces or line feeds is cut off from what is before
and after it by the byte-level pattern, so its ids are kept and used again; texts where that doesn't hold
(runs of white space, other white space, names of special tokens) are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bytewords import alone, chunks, hash_ranges
from quarry.llm.common import cut, fresh_path

END_ID = 2
#: Pieces whose ids are kept in a Python worker, at about 40 bytes each.
KEPT = 3_000_000

#: White space besides space and line feed: single bytes, and the UTF-8 beginnings of the rest.
_ODD_SPACE = np.zeros(256, dtype=bool)
_ODD_SPACE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_WIDE_SPACE = tuple(c.encode() for c in "\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200C))))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 32]] = True


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library and remembers the ids of pieces."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.kept = kept
        self._clear()

    def _clear(self) -> None:
        #: Sorted hashes of pieces, and the number of each; ids of piece k are ids[starts[k]:starts[k + 1]].
        self.hashes, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.ids, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode()
        word = text[1:] if text[0] == " " else text
        tail = []
        if len(word) > 1 and word[-1] in ",." and word[:-1].isalpha():  # a stop after letters is a token of its own
            tail = self.tokenizer.encode(word[-1], add_special_tokens=False).ids if word[-1] not in self.ends else self.ends[word[-1]]
            self.ends[word[-1]] = tail
            piece, word = piece[:-1], word[:-1]
        if word.isalpha() and max(word) < "\u0250":  # one match of the byte-level pattern: the library's model alone
            return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.letters))] + tail
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids + tail

    ends: dict[str, list[int]] = {}

    def _look_up(self, hashes: np.ndarray, buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of pieces; what is new is encoded."""
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        known = np.zeros(len(own), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == own[inside]
        new = np.flatnonzero(~known)
        if len(new):
            made = [self._encode_piece(buf[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            flat = np.fromiter((i for ids in made for i in ids), dtype=np.int32, count=int(sizes.sum()))
            numbers = np.arange(len(new), dtype=np.int64) + len(self.starts) - 1
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, flat])
            self.hashes, self.numbers = np.insert(self.hashes, at[new], own[new]), np.insert(self.numbers, at[new], numbers)
            at = np.searchsorted(self.hashes, own)
        return self.numbers[at][back]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        if len(self.hashes) > self.kept:
            self._clear()
        data = b"".join(texts)
        buf = np.frombuffer(data, dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
        brk = _BREAK[buf]
        # texts with white space at the edges, in runs or of other kinds, or with a special token, are encoded whole
        bad = [np.flatnonzero(_ODD_SPACE[buf]), np.flatnonzero(brk[1:] & brk[:-1])]
        filled = offsets[:-1][np.diff(offsets) > 0]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        bad += [filled[brk[filled]], last[brk[last]]]
        for mark in (*_WIDE_SPACE, *self.special):
            at = data.find(mark)
            while at >= 0:
                bad.append(np.array([at]))
                at = data.find(mark, at + 1)
        whole = np.unique(np.searchsorted(offsets, np.concatenate(bad), side="right") - 1)
        whole = {int(i): self.tokenizer.encode(texts[int(i)].decode(), add_special_tokens=False).ids for i in whole}
        cut = brk.copy()  # a piece begins at each space or line feed, and after a line feed
        cut[1:] |= buf[:-1] == 10
        cut[filled] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        mine = np.searchsorted(offsets, starts, side="right") - 1
        if whole:
            keep = ~np.isin(mine, list(whole))
            starts, ends, mine = starts[keep], ends[keep], mine[keep]
        k = self._look_up(hash_ranges(buf, starts, ends), data, starts, ends)
        at, sizes = self.starts[k], self.starts[k + 1] - self.starts[k]
        before = np.cumsum(sizes) - sizes
        flat = self.ids[np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(at - before, sizes)]
        lengths = np.bincount(mine, weights=sizes, minlength=len(texts)).astype(np.int64)
        if whole:
            parts, place = [], 0
            for i, n in enumerate(lengths.tolist()):
                parts.append(np.array(whole[i], dtype=np.int32) if i in whole else flat[place:place + n])
                place += n
                lengths[i] = len(parts[-1])
            flat = np.concatenate(parts)
        return flat, lengths


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encoder(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("token files", piece_encoder.cache_clear)
        encoder, place = piece_encoder(path), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            for a, b in chunks(pc.binary_length(texts).to_numpy()):
                flat, lengths = encoder.encode(texts.slice(a, b - a).to_pylist())
                ends = np.cumsum(lengths)
                flat = np.insert(flat, ends, end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends + np.arange(1, b - a + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.arange(place, place + b - a, dtype=np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["doc_id", "place", "ids"],
                )
                place += b - a

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, stripe_mb: int = 16, stride: int = 1000) -> None:
    """Encodes ``docs`` (doc_id, text) and writes doc_id, place, ids as ORC, a file for each range of doc_id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encoder(tokenizer, end_id), "doc_id long, place long, ids array<int>")
    encoded.write.option("compression", "zstd").option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", stride).option(
        "orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place, ids, file. A filter on doc_id is pushed down to files, stripes, row groups and Bloom filters."""
    return spark.read.schema("doc_id long, place long, ids array<int>").orc(path).withColumn("file", F.col("_metadata.file_name"))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())],
            names=["doc_id", "place", "file", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files at ``path``.

    The start is the sum of the files before and of the rows before in the file: two levels of running sums,
    one over a row for each file (by the number in its name), one inside each file. The files are read once.
    """
    rows = cut(read_ids(spark, path).select("doc_id", "place", "ids", "file").mapInArrow(
        _sums, "doc_id long, place long, file string, n_tokens long, ids_crc32 long"
    ))
    inside = Window.partitionBy("file").orderBy("place")
    rows = rows.select(
        "*", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("before"),
        F.sum("n_tokens").over(Window.partitionBy("file")).alias("of_file"), F.row_number().over(inside).alias("nth"),
    )
    files = rows.where("nth = 1").select(F.col("file").alias("__file"), "of_file")
    in_order = Window.orderBy(F.regexp_extract("__file", r"part-(\d+)", 1).cast("long"), "__file")
    files = files.select("__file", (F.sum("of_file").over(in_order) - F.col("of_file")).alias("files_before"))
    return rows.join(files, F.col("file") == F.col("__file")).select(
        "doc_id", (F.col("files_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` below the shared folder (or to ``path``) and gives the digests read back."""
    path = path or fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return digests(docs.sparkSession, path)
