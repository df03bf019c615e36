"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's items are the distinct 64-bit digests of its paragraphs: lines, parted after sentences of 80 characters or more
(and after 400 without an end), so a change reaches no further than the next end of a sentence. A fingerprint carries the
digests and two sketches of them: 24 cells in 3 tables (each item is in one cell of each table; a cell keeps the number of
its items and the exclusive or of their digests and of their checks), and parity words, each 64 bits over a quarter of the
items of the one before. Both sketches of two versions are subtracted. The parity words tell about how many digests
differ. If the cells may hold as many, they are peeled (take the item of a cell that holds one alone, remove it from its
other cells), which recovers the digests in which the versions differ. If not, or if peeling fails, the sketch is made
larger from the digests: split into as many blocks of 24 cells as the estimate asks for; blocks that fail are split into
four once more, until all are peeled. Other bits of a bijective hash part the items at each level, so
different digests end up apart, and the result is exact. The likeness of two fingerprints is common digests over all
digests, which the numbers of items and the difference give; nothing but the two fingerprints goes into it.

All of it is built-in functions on one row at a time. The next document comes from a window over ranges of
doc_id, each with a copy of the first row of the next range.

Rows: a null text counts as empty, without items; two empty texts are alike (1.0). Rows are ordered by doc_id
(nulls first), then text, so repeated rows follow each other. A single row is followed by itself. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import let

#: A paragraph, or a part of a long one.
PARAGRAPH = r"[^\n]{80,400}?[.!?](?=[ \t\r\n]|\z)|[^\n]{1,400}"
TABLES, WIDTH = 3, 8  # WIDTH is a power of two
CELLS = TABLES * WIDTH
#: Differing items that a block of cells is to hold, blocks that a failing one is split into, and the most levels.
PER_BLOCK, PARTS, LEVELS = 8, 4, 32
ROUNDS = 12
#: Parity words, and the bits that may differ in one for it to tell a number.
PARITIES, READABLE = 8, 20

ITEM, ITEMS = "struct<k:bigint,n:bigint>", "array<struct<k:bigint,n:bigint>>"


def items_of(text: Column) -> Column:
    """The distinct digests of the paragraphs of a text, in order of their values."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x))))


def _check(k: Column) -> Column:
    return F.xxhash64(k).bitwiseAND(0xFFFFFFFF)


def _shift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits.cast("int"))


def _places(k: Column, level: Column) -> list[Column]:
    """The cells (0 to CELLS - 1) of item ``k``, one in each table; each level takes other bits of the digest."""
    return [(_shift(k, F.pmod(9 * level, F.lit(54)) + 3 * t).bitwiseAND(WIDTH - 1) + t * WIDTH).cast("int") for t in range(TABLES)]


def _struct(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.alias("k"), h.alias("h"))


def _with_places(items: Column, level: Column) -> Column:
    """Items (k, n) with their check and cells."""
    return F.transform(items, lambda x: F.struct(
        x["k"].alias("k"), x["n"].alias("n"), _check(x["k"]).alias("h"), *[p.alias(f"p{t}") for t, p in enumerate(_places(x["k"], level))]
    ))


def _cells(signed: Column, level: Column) -> Column:
    """Cells of items (struct k, n): n is 1, or -1 for items that are taken away."""
    zero = lambda: _struct(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda a, x: _struct(a["n"] + x["n"], a["k"].bitwiseXOR(x["k"]), a["h"].bitwiseXOR(x["h"]))

    def table(items: Column, t: int) -> Column:
        numbers = F.sequence(F.lit(t * WIDTH), F.lit((t + 1) * WIDTH - 1))
        return F.transform(numbers, lambda c: F.aggregate(F.filter(items, lambda x: x[f"p{t}"] == c), zero(), add))

    return let(_with_places(signed, level), lambda items: F.concat(*[table(items, t) for t in range(TABLES)]))


def signed_items(items: Column, sign: int) -> Column:
    return F.transform(items, lambda k: F.struct(k.alias("k"), F.lit(sign).cast("long").alias("n")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _struct(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, level: Column) -> Column:
    """The digests that ``cells`` hold, or null if peeling doesn't empty them. Only cells that hold something are kept."""
    holds = lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)
    put = lambda c, n, k, h: F.struct(c.alias("c"), n.alias("n"), k.alias("k"), h.alias("h"))

    def step(state: Column) -> Column:
        def take(pure: Column) -> Column:
            remove = lambda a, p: put(a["c"], a["n"] - p["n"], a["k"].bitwiseXOR(p["k"]), a["h"].bitwiseXOR(p["h"]))
            left = F.filter(F.transform(state["cells"], lambda c: F.aggregate(
                F.filter(pure, lambda p: (p["p0"] == c["c"]) | (p["p1"] == c["c"]) | (p["p2"] == c["c"])), c, remove)), holds)
            got = F.concat(state["got"], F.transform(pure, lambda p: p["k"]))
            return F.when(F.size(pure) == 0, state).otherwise(F.struct(left.alias("cells"), got.alias("got")))

        single = F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (_check(c["k"]) == c["h"]))
        return let(_with_places(F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")))), level), take)

    full = F.filter(F.transform(cells, lambda c, i: put(i, c["n"], c["k"], c["h"])), holds)
    start = F.struct(full.alias("cells"), F.array().cast("array<bigint>").alias("got"))
    go = lambda s: F.when(F.size(s["cells"]) == 0, s).otherwise(step(s))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: go(s))
    return let(end, lambda e: F.when(F.size(e["cells"]) == 0, e["got"]))


def _found(signed: Column, level: Column) -> Column:
    """How many digests peeling recovers from the cells of ``signed``, -1 where it fails."""
    return let(peel(_cells(signed, level), level), lambda got: F.when(got.isNotNull(), F.size(got)).otherwise(-1))


def parities(items: Column) -> Column:
    """Parity words: in the j-th, each item of a 4^-j part of all turns one of 64 bits."""
    hashed = F.transform(items, lambda k: F.xxhash64(k, F.lit(1)))

    def word(hashes: Column, j: int) -> Column:
        own = hashes if j == 0 else F.filter(hashes, lambda h: h.bitwiseAND(4**j - 1) == 0)
        one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(one(h)))

    return let(hashed, lambda hashes: F.array(*[word(hashes, j) for j in range(PARITIES)]))


def estimate(a: Column, b: Column, most: Column) -> Column:
    """About how many digests differ, from two lists of parity words: told by the first word in which few enough bits
    differ; ``most`` if there is none."""
    def told(j: int) -> Column:
        bits = F.bit_count(a[j].bitwiseXOR(b[j]))
        return F.when(bits <= READABLE, -32.0 * 4**j * F.log(1 - bits / 32.0))

    return F.least(F.coalesce(*[told(j) for j in range(PARITIES)], most.cast("double")), most.cast("double"))


def larger_difference(signed: Column, levels: Column) -> Column:
    """The number of digests of one sign only: peeled from blocks of cells that are split ``levels`` times at first."""
    def step(state: Column, level: Column) -> Column:
        def deal(items: Column) -> Column:
            part = lambda x: _shift(F.xxhash64(x["k"]), 2 * level).bitwiseAND(PARTS - 1)
            return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda g: F.filter(items, lambda x: part(x) == g))

        def after(tried: Column) -> Column:
            failed = F.flatten(F.transform(F.filter(tried, lambda t: t["f"] < 0), lambda t: deal(t["b"])))
            got = F.aggregate(tried, F.lit(0), lambda s, t: s + F.greatest(t["f"], F.lit(0)))
            return F.struct(F.filter(failed, lambda x: F.size(x) > 0).alias("left"), (state["found"] + got).alias("found"))

        tried = F.transform(state["left"], lambda x: F.struct(x.alias("b"), F.when(level < levels, -1).otherwise(_found(x, level)).alias("f")))
        return F.when(F.size(state["left"]) == 0, state).otherwise(let(tried, after))

    start = F.struct(F.filter(F.array(signed), lambda x: F.size(x) > 0).alias("left"), F.lit(0).alias("found"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)
    return end["found"]


def with_difference(rows: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """``rows`` with ``to``: the number of digests in one of two fingerprints only (columns a_items, a_cells, a_parities ...)."""
    c = lambda x: F.col(f"__{x}")
    total = F.size(f"{a}_items") + F.size(f"{b}_items")
    one = rows.withColumn("__about", estimate(F.col(f"{a}_parities"), F.col(f"{b}_parities"), total))
    # a few more than a block is for still peel in most cases
    small = let(peel(subtract(F.col(f"{a}_cells"), F.col(f"{b}_cells")), F.lit(0)), lambda got: F.when(got.isNotNull(), F.size(got)).otherwise(-1))
    two = one.withColumn("__first", F.when(c("about") <= 1.5 * PER_BLOCK, small).otherwise(-1))
    signed = F.concat(signed_items(F.col(f"{a}_items"), 1), signed_items(F.col(f"{b}_items"), -1))
    three = two.withColumn("__signed", F.when(c("first") < 0, signed).otherwise(F.array().cast(ITEMS)))
    levels = F.ceil(F.log(float(PARTS), F.greatest(c("about") / PER_BLOCK, F.lit(1.0)))).cast("int")
    four = three.withColumn("__levels", F.greatest(levels, F.lit(1))).withColumn("__larger", larger_difference(c("signed"), c("levels")))
    return four.withColumn(to, F.when(c("first") >= 0, c("first")).otherwise(c("larger"))).drop("__about", "__first", "__signed", "__levels", "__larger")


def likeness(items_a: Column, items_b: Column, difference: Column) -> Column:
    """Common digests over all digests of two lists; 1.0 for two without any."""
    total = F.size(items_a) + F.size(items_b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - difference).cast("double") / (total + difference).cast("double"))


def written(name: str) -> Column:
    """A fingerprint as text: parity words, the count, digest and check of each cell (nothing for an empty one), digests; in
    hexadecimal."""
    cell = lambda c: F.when(c["n"] == 0, "").otherwise(F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["h"])))
    joined = lambda xs, f: F.array_join(F.transform(xs, f), ",")
    return F.concat_ws(":", joined(F.col(f"{name}_parities"), F.hex), joined(F.col(f"{name}_cells"), cell), joined(F.col(f"{name}_items"), F.hex))


def _ranges(docs: DataFrame, per_partition: int = 4, most: int = 512) -> DataFrame:
    """``docs`` with bucket: ranges of doc_id in order, with about as many rows each.

    At most ``most`` bounds are taken from approximate quantiles (one row on the driver); beyond that many
    ranges, each is divided evenly between its bounds.
    """
    wanted = per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coarse, fine = min(wanted, most), -(-wanted // most)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 20 * most)).first()[0] or [0]
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    place = F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(1))
    ranged = docs.withColumn("__at", place)
    low, high = F.element_at(bounds, F.col("__at")), F.coalesce(F.get(bounds, F.col("__at")), F.element_at(bounds, F.col("__at")) + 1)
    within = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * fine)
    within = F.greatest(F.least(within, F.lit(fine - 1)), F.lit(0))
    return ranged.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("__at").cast("long") * fine + within)).drop("__at")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text of each row, and next_text of the one after it (after the last, the first)."""
    ranged = _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    first = ranged.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    names = ranged.select("bucket").distinct()  # one row for each range
    order = names.select("bucket", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy())).alias("__before"))
    guests = first.join(order.withColumnRenamed("bucket", "__own"), F.col("bucket") == F.col("__own"))
    guests = guests.select("d.doc_id", "d.text", F.col("__before").alias("bucket"), F.lit(1).alias("guest"))
    both = ranged.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guests)
    by = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    led = both.select("doc_id", "text", "guest", F.lead("text").over(by).alias("next_text"))
    return led.where("guest = 0").drop("guest")


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of the column ``text``: name_items, name_cells, name_parities."""
    one = rows.withColumn(f"{name}_items", items_of(F.col(text)))
    items = F.col(f"{name}_items")
    return one.withColumns({f"{name}_cells": _cells(signed_items(items, 1), F.lit(0)), f"{name}_parities": parities(items)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``."""
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(length(text) / 4) as int))"))
    rows = with_next(docs).withColumns({"n_chars": n.cast("long"), "edited_text": edited})
    for text, name in (("text", "own"), ("edited_text", "edited"), ("next_text", "next")):
        rows = with_fingerprint(rows, text, name)
    rows = rows.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("text", "edited_text", "next_text")
    rows = with_difference(with_difference(rows, "own", "edited", "edited_apart"), "own", "next", "next_apart")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written("own").alias("fingerprint"), written("edited").alias("edited_fingerprint"),
        likeness(F.col("own_items"), F.col("edited_items"), F.col("edited_apart")).alias("near_edited"),
        likeness(F.col("own_items"), F.col("next_items"), F.col("next_apart")).alias("near_next"),
    )
