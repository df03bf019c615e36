"""A corpus pipeline: quality rules, near duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet in the shared
folder and read again as the docs of the next. All but the last return the columns of documents. Each gives an empty table
for an empty one; what it does with nulls stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, ngram_join, pieces, quality, secrets
from quarry.llm.common import cut, table
from quarry.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their hosts' verdicts keep. A null text has no words and goes; the null source is a host."""
    judged = quality.judge(docs)
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Texts without words stay, and rows without doc_id; rows of one doc_id are one."""
    return ngram_join.first_of_groups(ship(spark) and docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets taken out of their texts. A null text stays null."""
    clean = secrets.redact(ship(spark) and docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Texts without words are never taken; the null source is one of its own."""
    return mixing.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, the text decoded from them and sampled segmentations, with their digests. A null text counts as empty."""
    return pieces.encode(ship(spark) and docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]

#: The network, the random mixture and the sampler have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
