"""The corpus operators applied to their whole tables, and what SQL can say of them."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm import chat_format, decontaminate, fingerprints, html_extract, language_id, line_dedup, near_dedup, packing, quality, toxicity
from curatrix.llm.common import held_out, read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; $CURATRIX_TOKENIZERS names another folder."""
    folder = os.environ.get("CURATRIX_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, lines, removed = line_dedup.deduplicate(docs)
    return out.select("doc_id", "text", lines.alias("n_lines"), removed.alias("n_removed"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.conversations(chat_format.linear(messages), numbered=True)
    kind = "struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>"
    return out.select(F.col("tree").alias("conv_id"), arrow_udf(chat_format.read_back, kind)("formatted", "starts", "ends").alias("d")).select("conv_id", "d.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return packed_digest(pieces)


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    graded = quality.grade(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "selected")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.compare(read(spark, sf_dir, "documents"))
    return compared.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_prefix")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.main_texts(read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP2_SQL = r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
place AS (
  SELECT doc_id, i, trim(lines[i]) || chr(10) || trim(lines[i + 1]) || chr(10) || trim(lines[i + 2]) AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM doc WHERE len(lines) >= 3)),
first AS (
  SELECT w, min({'d': doc_id, 'i': i}) AS f FROM place WHERE w <> chr(10) || chr(10) GROUP BY w HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, i + j AS k FROM place JOIN first USING (w), (VALUES (0), (1), (2)) AS t(j)
  WHERE {'d': doc_id, 'i': i} <> f),
line AS (SELECT doc_id, k, lines[k] AS l FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM doc)),
kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY k) AS t, count(*) AS n
  FROM line ANTI JOIN covered USING (doc_id, k) GROUP BY doc_id)
SELECT doc.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS BIGINT) AS n_removed
FROM doc LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '###', '\###') AS t,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '###', '\###'), ':', '\:') AS r
  FROM turns)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 14) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT m FROM pattern),
place AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, size WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, place.m FROM place JOIN pattern ON place.p = pattern.p AND place.m = pattern.m),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_line_dedup": op2_line_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_near_dedup": op4_near_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_decontaminate": op8_decontaminate,
        "op9_fingerprints": op9_fingerprints,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op8_decontaminate": OP8_SQL}
