"""The queries opN_<name> and ``pipeline``: operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rank import ranked
from . import bpe, chat, jaccard, language, mixing, quality, secrets, token_files, topk, url_filter
from .shared import scratch, table

#: Host and path rules of op8.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def source_weights(docs: DataFrame) -> DataFrame:
    """Sources by code point, null last, weigh 5, 2, 1, repeating.  One row for each source."""
    names = ranked(docs.select("source").distinct(), [F.col("source").asc_nulls_last()], "place")
    return names.select("source", F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("place") % 3).cast("int") + 1).alias("weight"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'token-files')}/ids"
    token_files.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_ids(spark, path).withColumnRenamed("key", "doc_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.Join(table(spark, sf_dir, "documents"), width=3, percent=90).components()
    return out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("key"))
    return quality.judge(table(spark, sf_dir, "documents"), clean).withColumnRenamed("key", "doc_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.training(secrets.generated_findings(spark))
    found = secrets.find(table(spark, sf_dir, "documents"), forest)
    return found.select(F.col("key").alias("doc_id"), "n_candidates", "n_secrets", "score", "secrets_sha256", F.sha2(F.coalesce("redacted", F.lit("")).cast("binary"), 256).alias("redacted_sha256"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = topk.Index.build(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return index.search(20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language.train(docs, ~held_out(F.col("doc_id")))
    out = language.identify(docs.select("doc_id", "text"), network).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Documents that the language model never learns from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op6_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.code(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ids=False)
    return out.select(F.col("key").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


#: The conversation that op2 adds: control strings inside texts.
CONTROL = r"\### Assistant: </turn> ok"


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "chat")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chat.write_tree(turns.unionByName(own), path, tokenizer_path("byte_bpe_50k.json"))
    return chat.read_tree(spark, path)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, source_weights(docs), share=1.5, max_epochs=2.0, seed=20240229)
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_chat_tree": op2_chat_tree,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_compression_bands": op5_compression_bands,
        "op6_bpe_coding": op6_bpe_coding,
        "op7_secret_scan": op7_secret_scan,
        "op9_pivot_topk": op9_pivot_topk,
        "op10_language_id": op10_language_id,
        "op3_source_mixing": op3_source_mixing,
        "op8_url_filter": op8_url_filter,
    }


#: Conversations and the added one; a turn is "### role", its text and "</turn>", with one more character for each \\, # and < (in a role, each line break as well).
OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(13 + length(role) + length(text) + length(regexp_replace(role, '[^\\\\#<\\n]', '', 'g')) + length(regexp_replace(text, '[^\\\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), u AS (
  SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, len(w) AS n FROM d WHERE len(w) >= 3
), s AS (
  SELECT DISTINCT doc_id, a || ' ' || b || ' ' || c AS g FROM u WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT met.a, met.b FROM met JOIN sizes m ON m.doc_id = met.a JOIN sizes n ON n.doc_id = met.b WHERE 100 * met.n >= 90 * (m.n + n.n - met.n)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)
"""

OP9_SQL = """
WITH ok AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL) WHERE x IS NULL OR NOT isfinite(x))
), v AS (
  SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM ok)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; tests hold the others against brute force, round trips or held-out accuracy."""
    return {"op2_chat_tree": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op9_pivot_topk": OP9_SQL}
