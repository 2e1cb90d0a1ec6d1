"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import chat, counting, jaccard, mixing, nearest, packing, quality, scoring, suffix, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(_table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(_table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_table(spark, sf_dir, "documents"))


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures_of(_table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return found.select("id", "canonical", "status", "response_id", shown.alias("headers"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_by_line(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(rows))
    turns = chat.canonical_rows(table.unionByName(extra))
    return chat.read_back(chat.format_chats(turns, "conv_id"), "conv_id")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_jaccard, op4_suffix, op5_scoring, op6_warc, op7_quality, op8_tokens, op9_nearest, op10_chat)}

_CANONICAL = r"""
CASE WHEN scheme = '' THEN plain ELSE scheme || '://' ||
  CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END ||
  CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END
"""

ORACLES = {
    "op6_warc": rf"""
WITH base AS (SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, page_id * 600 AS t FROM pages),
parts AS (SELECT *, split_part(trim(url), '#', 1) AS plain FROM base),
split AS (SELECT *, lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.\-]*://(.*)$', 1) AS rest FROM parts),
fields AS (SELECT *, lower(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', '')) AS host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '^[^?]*\?(.*)$', 1) AS query FROM split),
named AS (SELECT page_id, t, tag, {_CANONICAL} AS canonical FROM fields),
asked AS (
  SELECT page_id * 3 + 1 AS id, canonical, t + 60 AS time, 'W/' || tag AS tag, true AS soon FROM named
  UNION ALL SELECT page_id * 3 + 2, canonical, t + 86400, CASE WHEN page_id % 3 = 0 THEN '"stale"' ELSE tag END, false FROM named),
joined AS (
  SELECT a.id, a.canonical, a.time, a.tag, a.soon, n.page_id, n.tag AS stored FROM asked a LEFT JOIN named n ON n.canonical = a.canonical AND n.t < a.time
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY n.t DESC NULLS LAST, n.page_id DESC) = 1),
told AS (SELECT *, CASE WHEN page_id IS NULL THEN 'missing' WHEN regexp_replace(tag, '^W/', '') = stored THEN 'resolved' ELSE 'changed' END AS status FROM joined)
SELECT id, canonical, status, CASE WHEN status = 'resolved' THEN page_id * 3 END AS response_id,
  CASE WHEN status = 'resolved' THEN 'content-type=text/html;' WHEN soon THEN 'content-type=x/ignored;' ELSE '' END || 'date=' || time || ';etag=' || tag AS headers
FROM told""",
    "op10_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + 2 * length(role) - length(replace(replace(replace(role, '~', ''), '<', ''), '[', '')) + 2 * length(text) - length(replace(replace(replace(text, '~', ''), '<', ''), '[', '')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
}
