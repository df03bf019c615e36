"""Quality rules judged by host: rule failures are counted by domain, the rates are shrunk towards an
empirical beta prior, and the verdict on a host is joined back to its documents.

Rows: every row gets a verdict of its own. A null text counts as empty (no words, so it fails). A null
host is a host of its own. Repeated rows count as often as they occur. An empty table gives an empty
result. Other columns of the input are carried along unless ``keep`` names fewer; columns of the input
that clash with result columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """Limits. A document that breaks a base rule is rejected; the host rules only count towards its host."""

    min_words: int = 50
    #: Percent of words inside repeated 3-word windows.
    max_repeat_pct: int = 50
    #: Host rules: symbols per 100 words, repeated lines per 100 words, mean word length.
    max_symbol_pct: int = 30
    max_dup_line_pct: int = 10
    min_mean_chars: int = 2
    max_mean_chars: int = 15
    #: A host is rejected if its shrunk failure rate less so many posterior deviations is above this rate.
    host_rate: float = 0.6
    deviations: float = 2.0
    #: Bounds of the prior's weight, in documents.
    min_weight: float = 2.0
    max_weight: float = 1000.0


def count_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all by built-in functions.

    Within one document, the 3-word windows are sorted with their places; equal neighbours are repeats. The
    places of repeats, in order, cover ``min(3, distance to the next)`` words each. No row is exploded, so
    nothing is shuffled, and memory is that of one document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, size = F.col("__words"), F.size("__words")
    one = docs.withColumns({
        "__words": words_of(F.col(text)),
        "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"),
        "__lines": lines,
    })
    two = one.withColumns({
        "n_words": size.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__grams": F.sort_array(F.transform(
            F.slice(w, 1, F.greatest(size - 2, F.lit(0))),
            lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")),
        )),
    }).drop("__lines")
    g = F.col("__grams")
    three = two.withColumn("__places", F.sort_array(F.transform(
        F.filter(g, lambda x, i: (x["g"] == F.get(g, i + 1)["g"]) | (x["g"] == F.get(g, i - 1)["g"])),
        lambda x: x["p"],
    ))).drop("__words", "__grams")
    p = F.col("__places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    return three.withColumn("n_repeat_words", covered.cast("long")).drop("__places")


def base_failed(rules: HostRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def rule_failed(rules: HostRules) -> Column:
    """Whether any rule fails; this is what is counted by host."""
    n = F.col("n_words")
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.max_symbol_pct * n)
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_pct * n)
        | (F.col("word_chars") < rules.min_mean_chars * n)
        | (F.col("word_chars") > rules.max_mean_chars * n)
    )


def host_verdicts(counted: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """One row for each host: __host, host_docs, host_failed, host_rate, host_rejected.

    Rates are shrunk towards a beta prior fitted to all hosts by moments. Counts are partially summed on the
    map side, so a host with a third of all rows sends one row from each task.
    """
    hosts = counted.groupBy(F.col(host).alias("__host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("__failed").cast("long")).alias("host_failed")
    )
    prior = hosts.select(
        F.col("host_docs").cast("double").alias("n"), (F.col("host_failed") / F.col("host_docs")).alias("r")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("f"),
        F.sum(F.col("n") * F.col("r") * F.col("r")).alias("s"),
    ).select(
        F.col("k"), F.col("n"), (F.col("f") / F.col("n")).alias("mean"),
        F.greatest(F.col("s") / F.col("n") - F.pow(F.col("f") / F.col("n"), 2), F.lit(0.0)).alias("spread"),
    ).select(
        "mean",
        # spread between hosts beyond what k hosts of n / k documents show by chance
        (F.col("spread") - F.col("mean") * (1 - F.col("mean")) * F.col("k") / F.col("n")).alias("between"),
    ).select(
        F.greatest(F.least(F.col("mean"), F.lit(1 - 1e-6)), F.lit(1e-6)).alias("mean"),
        F.when(
            F.col("between") > 0,
            F.greatest(F.lit(rules.min_weight), F.least(F.lit(rules.max_weight), F.col("mean") * (1 - F.col("mean")) / F.col("between") - 1)),
        ).otherwise(F.lit(rules.max_weight)).alias("weight"),
    )
    a = F.col("host_failed") + F.col("mean") * F.col("weight")
    n = F.col("host_docs") + F.col("weight")
    return hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", a / n).withColumn(  # the prior is one row
        "host_rejected",
        F.col("host_rate") - rules.deviations * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + 1)) > rules.host_rate,
    ).select("__host", "host_docs", "host_failed", "host_rate", "host_rejected")


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: HostRules | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs``, with the counts, base_failed and kept."""
    rules = rules or HostRules()
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in out]
    counted = count_columns(docs, text).withColumns({
        "base_failed": base_failed(rules), "__failed": rule_failed(rules), "__host": F.col(host).cast("string"),
    })
    # Written once: the counts are read both by the hosts' rates and by the join back. The verdicts are written
    # too, so that their size is known and the join is a broadcast only where they are small.
    counted = cut(counted.select(*names, *out[:-1], "__failed", "__host"))
    verdicts = cut(host_verdicts(counted, "__host", rules)).select(F.col("__host").alias("__judged"), "host_rejected")
    joined = counted.join(verdicts, F.col("__host").eqNullSafe(F.col("__judged")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).select(*names, *out)
