"""The queries opN_* and their SQL: thin uses of this subpackage's operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.sanitise import personal_data, span_digest

    return span_digest(personal_data(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.media_columns import read_media, store_media

    return read_media(store_media(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.language_id import held_out, identify, learned_from

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned_from(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.sentencepiece_bpe import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.line_dedup import dedup_lines, line_digest

    return line_digest(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.chat_format import conversation_digest, format_turns

    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversation_digest(format_turns(turns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearkin.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sanitise, op2_token_counts, op3_media_columns, op4_language_id, op5_sentencepiece, op6_near_dedup, op7_substring_dedup, op8_line_dedup, op9_chat_format, op10_decontaminate)}

#: The chat template's escapes in SQL: a backslash is doubled, and `\:` goes behind the first character of a mark.
_ESCAPED = r"regexp_replace(replace(coalesce(text, ''), '\', '\\'), '(<)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\:\2\4', 'g')"

ORACLE: dict[str, str] = {
    "op9_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(17 + length(role) + length({_ESCAPED})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS win
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dp AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE w IS NOT NULL AND len(w) >= k),
hit AS (SELECT DISTINCT doc_id, i, dp.k AS k, item_id FROM dp JOIN iw ON dp.win = iw.win AND dp.k = iw.k),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hit) h, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, i FROM win JOIN least USING (s) WHERE m < doc_id), unnest(range(i, i + 13)) AS t(j)),
words AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
c AS (SELECT v, min(u) AS m FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, d.doc_id = coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id""",
}
