"""Cleaning of entity records: reviews joined in, duplicates out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import dedup_key


def dedup_first(rows: DataFrame, keys: Sequence[str], order: str = "doc_id") -> DataFrame:
    """The first row, by ``order``, of each group of equal normalised keys."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = rows.withColumns({n: dedup_key(F.col(k)) for n, k in zip(names, keys)})
    first = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*names).orderBy(order)))
    return first.where("__r = 1").drop("__r", *names)


def review_lists(reviews: DataFrame, key: Column, order: str) -> DataFrame:
    """__key, reviews: the reviews of each key in order."""
    return reviews.groupBy(key.alias("__key")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*reviews.columns).alias("r")))), lambda x: x["r"]).alias("reviews")
    )


def join_reviews(companies: DataFrame, key: Column, first: DataFrame, second: DataFrame) -> DataFrame:
    """``companies`` with reviews (of the first source, then of the second) and has_review; both null without any."""
    keyed = companies.withColumn("__key", key)
    one = keyed.join(first.withColumnRenamed("reviews", "__a"), "__key", "left")
    two = one.join(second.withColumnRenamed("reviews", "__b"), "__key", "left")
    both = F.concat(F.coalesce("__a", F.array().cast(first.schema["reviews"].dataType)), F.coalesce("__b", F.array().cast(first.schema["reviews"].dataType)))
    some = F.col("__a").isNotNull() | F.col("__b").isNotNull()
    return two.withColumns({"reviews": F.when(some, both), "has_review": F.when(some, F.lit(True))}).drop("__key", "__a", "__b")
