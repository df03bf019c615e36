"""What happens to a list of hits: boosts, metadata, thresholds, filters, facets, pages, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import blank, province, relevance_percent, strip

UNKNOWN_REPRESENTATIVE = "Chưa cập nhật"
CSV_HEADERS = ("Tên công ty", "Mã số thuế", "Địa chỉ", "Người đại diện", "Trạng thái", "Ngành nghề")


def industry(seg: Column, plain: Column, names: Column) -> Column:
    """The first that is not empty: segmented, plain, or the joined names of a list."""
    joined = F.array_join(F.filter(names, lambda x: blank(x) != ""), ", ")
    return F.coalesce(F.nullif(seg, F.lit("")), F.nullif(plain, F.lit("")), joined, F.lit(""))


def representative(c: Column) -> Column:
    return F.when((blank(c) == "") | (F.lower(c) == "none"), UNKNOWN_REPRESENTATIVE).otherwise(c)


def clean_address(c: Column) -> Column:
    return F.regexp_replace(c, r"^[, ]+|[, ]+$", "")


def with_metadata(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` (doc_id ...) with the documents' columns. Spark broadcasts the hits where they are few."""
    return docs.join(hits, "doc_id")


def boost(hits: DataFrame, query: str, top: DataFrame | None = None) -> DataFrame:
    """Rule boosts for queries of two words at least. hits: doc_id, score, company_name, address.

    top: a row with the best score. Without it the hits, at most a pool, are gone through by one task.
    """
    q = query.strip().lower()
    words = q.split()
    if len(words) < 2:
        return hits
    name, addr = F.lower(strip(blank(F.col("company_name")))), F.lower(strip(blank(F.col("address"))))
    phrase = F.concat(F.lit(" "), name, F.lit(" ")).contains(f" {q} ")
    subset = F.size(F.array_except(F.array(*[F.lit(w) for w in words]), F.split(name, r"(?U)\s+"))) == 0
    by_name = F.when(name == q, 1.0).when(phrase, 0.5).when(subset, 0.3).otherwise(0.0)
    by_addr = F.when(addr == q, 0.8).when(addr.contains(q), 0.2).otherwise(0.0)
    b = F.col("__b")
    if top is None:
        topped = hits.withColumn("__top", F.max("score").over(Window.partitionBy()))
    else:
        topped = hits.crossJoin(F.broadcast(top.toDF("__top")))
    boosted = topped.withColumn("__b", by_name + by_addr)
    new = F.when(b > 0, F.col("__top") + F.col("__top") * b + F.col("score") * 0.1).otherwise(F.col("score"))
    return boosted.withColumn("score", F.round(new, 6)).drop("__b", "__top")


def find_id(docs: DataFrame, wanted: str) -> DataFrame:
    """The last document with this tax code."""
    hit = docs.where(F.col("tax_code") == wanted)
    last = hit.agg(F.max("doc_id").alias("__last"))
    return hit.join(F.broadcast(last), F.col("doc_id") == F.col("__last")).drop("__last")


def above_threshold(hits: DataFrame, percent: int = 70) -> DataFrame:
    """Hits whose score, rounded to percent of the best, reaches ``percent``."""
    return with_percent(hits).where(F.col("percent") >= percent)


def with_percent(hits: DataFrame) -> DataFrame:
    """``hits`` with percent, their score in percent of the best."""
    top = hits.agg(F.max("score").alias("__top"))  # a row
    return hits.crossJoin(F.broadcast(top)).withColumn("percent", relevance_percent(F.col("score"), F.col("__top"))).drop("__top")


def is_inactive(status: Column) -> Column:
    low = F.lower(blank(status))
    return low.contains("ngừng") | low.contains("giải thể")


def by_status(hits: DataFrame, active: bool) -> DataFrame:
    return hits.where(~is_inactive(F.col("status")) if active else is_inactive(F.col("status")))


def by_province(hits: DataFrame, name: str) -> DataFrame:
    return hits.where(province(F.col("address")) == name)


def province_facet(hits: DataFrame) -> DataFrame:
    """province, hits: the number of hits of each province."""
    return hits.select(province(F.col("address")).alias("province")).where("province is not null").groupBy("province").agg(F.count(F.lit(1)).alias("hits"))


def facet_names(hits: DataFrame) -> DataFrame:
    """province: the provinces of the hits in Vietnamese order."""
    return province_facet(hits).select("province").orderBy(F.expr("province collate vi"))


def page(hits: DataFrame, number: int, size: int = 10) -> DataFrame:
    return hits.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def export_rows(hits: DataFrame) -> DataFrame:
    """The columns of an export, with its headers."""
    names = ("company_name", "tax_code", "address", "representative", "status", "industry")
    return hits.select(*[F.col(c).alias(h) for c, h in zip(names, CSV_HEADERS)])


def export_name(query: str) -> str:
    """The name of an export: the first ten characters of its query."""
    return f"{query[:10]}.csv"


def write_csv(hits: DataFrame, path: str) -> None:
    """Quoted CSV with a byte order mark, quotes doubled; one file, as exports are a list of hits."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(blank(F.col(f"`{c}`")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = export_rows(hits)
    head = rows.sparkSession.createDataFrame([("﻿" + ",".join(f'"{h}"' for h in CSV_HEADERS), 0)], "value string, at int")
    body = rows.select(F.concat_ws(",", *[quoted(c) for c in rows.columns]).alias("value"), F.lit(1).alias("at"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
