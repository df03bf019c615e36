"""The queries of the training-data operators and, where SQL can say the same, their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, fingerprint, mixing, ngram_join, pieces, quality, secrets, substring, token_files, toxicity
from quarry.llm.common import table
from quarry.session import ship


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, hosts being the sources."""
    return quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, held against its edited text's and the next document's."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


#: A conversation whose texts are control strings.
HARD_CHAT = [(-1, turn, role, f"{chat.END}{chat.START}{chat.LOSS_ROLE} ok") for turn, role in enumerate(("user", "assistant"))]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is hard to format, read back from their formatted texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_CHAT, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(hard)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and near-duplicate component."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's findings."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's encoding and two sampled segmentations."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of text that documents share, and which of them go."""
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number and checksum of token ids, read back from ORC files."""
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_quality_rules, op3_fingerprints, op4_mixing, op5_chat_format, op6_ngram_join, op7_secret_scan, op8_pieces, op9_substring_dedup, op10_token_files)
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in found}


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
counted AS (
  SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
failed AS (
  SELECT *, base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS any_failed FROM ruled),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(any_failed AS INT)) AS DOUBLE) AS f
  FROM failed GROUP BY source),
moments AS (
  SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean,
         greatest(sum(n * (f / n) * (f / n)) / sum(n) - pow(sum(f) / sum(n), 2), 0) AS spread FROM hosts),
prior AS (
  SELECT greatest(least(mean, 1 - 1e-6), 1e-6) AS mean,
         CASE WHEN spread - mean * (1 - mean) * k / n > 0
              THEN greatest(2.0, least(1000.0,
                     greatest(least(mean, 1 - 1e-6), 1e-6) * (1 - greatest(least(mean, 1 - 1e-6), 1e-6))
                     / (spread - mean * (1 - mean) * k / n) - 1))
              ELSE 1000.0 END AS weight FROM moments),
rates AS (
  SELECT source, n + weight AS n, (f + mean * weight) / (n + weight) AS r FROM hosts, prior),
verdicts AS (SELECT source, r - 2 * sqrt(r * (1 - r) / (n + 1)) > 0.6 AS rejected FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""


CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES
    (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
marked AS (
  SELECT *, regexp_matches(text, '<\\+\||<\|im_(start|end)\|>') AS hard,
         length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS longer FROM said)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + CASE WHEN hard THEN longer ELSE length(text) END
                + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 75 * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": JACCARD_SQL, "op5_chat_format": CHAT_SQL, "op2_quality_rules": QUALITY_SQL}
