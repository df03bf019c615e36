"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, the source's target over its
size. The whole part is taken as it is. The fractions are rounded in pairs: words move at random from one
document to the other until one fraction is 0 or 1, so the sum of words stays exact and every expectation
holds. Pairs are formed inside blocks of bounded size; the one fraction that a block may have left goes to
the next level of a reduction tree, and only the last one of a source is rounded alone. A source's words
thus differ from its target by less than one document.

Rows: a null or blank text has size 0 and is never taken. The null source comes last and is a source of its
own. Rows that agree in id, source and text are counted and mixed one by one. An empty table gives no rows.
Random choices are hashes of ids and sizes, so reruns and other partitionings give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, n_words_of, unit_hash

#: Documents in a block of the reduction tree, on average.
BLOCK = 48
UNIT = "struct<doc_id:bigint,mark:bigint,nth:bigint,size:bigint,p:double>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, docs, source_size, target: one row for each source.

    Sources by code point, null last, have the weights in turn. They share ``share`` times all words. A target
    stops at ``limit`` times its source's words; what is above goes to the others by weight. With sources in the
    order of (limit x size / weight), those that stop are a prefix, so running sums give the final shares. Both orders
    are ranges, each worked on by a task; only a row for each range, and one of totals, come together.
    """
    one = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    numbered = _with_sums(one, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("turn"), F.lit(len(weights))) + 1).cast("int"))
    two = numbered.select("source", "docs", "source_size", w.alias("w"), (F.lit(float(limit)) * F.col("source_size")).alias("cap"))
    ratio = F.col("cap") / F.col("w")
    three = _with_sums(two, [ratio.asc(), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("w")})
    sums = three.agg(F.sum("source_size").alias("__size"), F.sum("w").alias("__w"))  # a row
    level = (F.lit(float(share)) * F.col("__size") - F.col("caps")) / (F.col("__w") - F.col("weights"))
    four = three.crossJoin(F.broadcast(sums)).withColumn("level", level)
    # the final share of a unit of weight is that of the first source that doesn't stop
    place = F.struct(ratio.alias("r"), F.col("source").isNull().alias("last"), F.col("source").alias("s"))
    unit = four.where(F.col("cap") > F.col("level") * F.col("w")).agg(F.min_by("level", place).alias("unit"))  # a row
    target = F.least(F.col("cap"), F.coalesce(F.col("unit") * F.col("w"), F.col("cap")))
    return four.crossJoin(F.broadcast(unit)).select("source", "docs", "source_size", target.alias("target"))


def _with_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over the rows before in ``order``: of the ranges before, and inside the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{k}").over(over), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = ranged.withColumns({k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in sums.items()})
    return inside.join(F.broadcast(totals), "__range").withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums])


def _step(state: Column, x: Column, level: int, seed: int) -> Column:
    """One pivotal step: the fraction that is carried meets ``x``. state: carried (null: none) and done."""
    c = state["carried"]
    up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that c can gain from x
    down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
    gains = unit_hash(F.lit(seed), F.lit(level), c["doc_id"], c["mark"], c["nth"], x["doc_id"], x["mark"], x["nth"]) * (up + down) < down
    moved = F.when(gains, up).otherwise(-down)

    def unit(u: Column, p: Column) -> Column:
        # what is within rounding error of a whole number is one
        p = F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)
        return F.struct(u["doc_id"].alias("doc_id"), u["mark"].alias("mark"), u["nth"].alias("nth"), u["size"].alias("size"), p.alias("p")).cast(UNIT)

    pair = F.array(unit(c, c["p"] + moved / c["size"]), unit(x, x["p"] - moved / x["size"]))
    whole = lambda u: (u["p"] == 0.0) | (u["p"] == 1.0)
    met = F.transform(F.array(pair), lambda two: F.struct(
        F.get(F.filter(two, lambda u: ~whole(u)), F.lit(0)).alias("carried"),
        F.concat(state["done"], F.filter(two, whole)).alias("done"),
    ))[0]
    return F.when(c.isNull(), F.struct(x.cast(UNIT).alias("carried"), state["done"].alias("done"))).otherwise(met)


def _fold(units: DataFrame, level: int, seed: int) -> DataFrame:
    """units: source, block, blocks, unit. Gives source, block, blocks, state of each block."""
    key = unit_hash(F.lit(seed + level), F.col("unit.doc_id"), F.col("unit.mark"), F.col("unit.nth"))
    groups = units.groupBy("source", "block", "blocks").agg(
        F.sort_array(F.collect_list(F.struct(key.alias("at"), F.col("unit").alias("u")))).alias("list")
    )
    empty = F.struct(F.lit(None).cast(UNIT).alias("carried"), F.array().cast(f"array<{UNIT}>").alias("done"))
    state = F.aggregate("list", empty, lambda s, x: _step(s, x["u"], level, seed))
    return groups.select("source", "block", "blocks", state.alias("state"))


def round_pivotal(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Rounds fractions. units: source, docs (of the source), doc_id, mark, nth, size above 0, p in (0, 1).

    Gives source, doc_id, mark, nth, size, p with p 0.0 or 1.0. A block's members are hashed by row, identical
    rows by their number, so no key fills a block; each level has at most 1 / ``block`` of the rows before.
    """
    blocks = F.ceil(F.col("docs") / F.lit(float(block))).cast("long")
    at = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark", "nth"), F.col("blocks"))
    level_in = units.withColumn("blocks", blocks).select(
        "source", at.alias("block"), "blocks", F.struct("doc_id", "mark", "nth", "size", "p").cast(UNIT).alias("unit")
    )
    most = units.agg(F.max(F.ceil(F.col("docs") / F.lit(float(block))))).first()[0] or 1
    done, level = None, 0
    while True:
        folded = cut(_fold(level_in, level, seed))
        part = folded.select("source", F.explode("state.done").alias("u"))
        done = part if done is None else done.unionByName(part)
        left = folded.where("state.carried is not null").select("source", "block", "blocks", F.col("state.carried").alias("u"))
        if most <= 1:
            u = F.col("u")
            last = (unit_hash(F.lit(seed), F.lit("last"), u["doc_id"], u["mark"], u["nth"]) < u["p"]).cast("double")
            done = done.unionByName(left.select("source", u.withField("p", last).alias("u")))
            return done.select("source", "u.*")
        most, level = -(-most // block), level + 1
        level_in = left.select(
            "source", F.floor(F.col("block") / block).cast("long").alias("block"),
            F.ceil(F.col("blocks") / F.lit(float(block))).cast("long").alias("blocks"), F.col("u").alias("unit"),
        )


#: Equal rows that are made by one task.
EQUAL = 4096


def _in_blocks(rows: DataFrame, key: str, times: str, nth: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1. Blocks are dealt out first, so no task makes all copies of a row."""
    begun = rows.withColumn("__from_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times), F.lit(EQUAL).cast("long"))))
    dealt = begun.repartition(F.xxhash64(key, "__from_copy"))
    last = F.least(F.col("__from_copy") + (EQUAL - 1), F.col(times))
    return dealt.withColumn(nth, F.explode(F.sequence(F.col("__from_copy"), last))).drop("__from_copy")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, mark (hash of the text), nth (among equal rows), size, source, source_size, target, copies: a row for each row of ``docs``."""
    sizes = cut(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"),
        F.col(source).cast("string").alias("source"), n_words_of(F.col(text)).alias("size"),
    ).groupBy("doc_id", "mark", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    few = sizes.where(F.col("rows") <= EQUAL).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    each = few.unionByName(_in_blocks(sizes.where(F.col("rows") > EQUAL), "mark", "rows", "nth")).drop("rows")
    targets = cut(source_targets(each, weights, share, limit)).withColumnRenamed("source", "__source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = each.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").select(
        "*", F.floor(expected + 1e-12).alias("base"), (expected - F.floor(expected + 1e-12)).alias("p")
    )
    even = (F.col("size") == 0) | (F.col("p") < 1e-9)
    whole = rows.where(even).select("*", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base")).cast("long").alias("copies"))
    done = round_pivotal(rows.where(~even).select("source", "docs", "doc_id", "mark", "nth", "size", "p"), seed)
    again = targets.select("__source", "source_size", "target", F.floor(expected + 1e-12).alias("base"))
    mixed = done.join(again, F.col("source").eqNullSafe(F.col("__source"))).withColumn("copies", (F.col("base") + F.col("p")).cast("long"))
    out = ["doc_id", "mark", "nth", "size", "source", "source_size", "target", "copies"]
    return whole.select(*out).unionByName(mixed.select(*out))


def take(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them. Rows that agree in id, source and text share their copies."""
    share = mix(docs, seed=seed).groupBy("doc_id", "mark", "source").agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")
    ).where("__copies > 0").toDF("__id", "__mark", "__source", "__copies", "__rows")
    # one of equal rows stands for the copies of all of them
    marked = docs.withColumn("__m", F.xxhash64("text"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    joined = marked.join(share, on)
    alone = joined.where("__rows = 1")
    several = joined.where("__rows > 1").dropDuplicates(["__id", "__mark", "__source"])
    once = alone.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return once.unionByName(_in_blocks(several, "__mark", "__copies", "__copy")).select(*docs.columns)
