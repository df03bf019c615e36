"""Record sources: JSON lines with an explicit schema, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REVIEW = "struct<source:string,url:string,company_name:string,company_address:string,title:string,rating:int,content:string>"
COMPANY = (
    "company_name string, tax_code string, address string, source string, url string, crawled_at string, representative string, phone string, "
    f"status string, founded_date string, industries_detail array<struct<code:string,name:string>>, reviews array<{REVIEW}>, has_review boolean, "
    "industries_str string, company_name_seg string, address_seg string, representative_seg string, status_seg string, industries_str_seg string"
)
BAD = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str, schema: str = COMPANY) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad lines. Blank lines are skipped."""
    full = StructType([*StructType.fromDDL(schema).fields, StructField(BAD, StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return rows.where(F.col(BAD).isNull()).drop(BAD), rows.where(F.col(BAD).isNotNull()).select(BAD)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file, or none where there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return read_json_lines(spark, path, schema)[0]


def number_rows(rows: DataFrame) -> DataFrame:
    """Rows with doc_id, their number in file order. For sources without a key of their own.

    A row's number is that in its partition, and the sizes of the partitions before: a row for each is summed up.
    """
    placed = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(sizes), "__part").select((F.col("__at") + F.col("__before")).alias("doc_id"), *rows.columns)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
