"""The queries of this subpackage over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, hmm, jaccard, langid, media, packing, pii, quality, simhash, spiece, topk, whitening
from .common import in_fold, table

#: Where the public tokenizers lie; a path parameter of the operators that read them.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spiece.digests(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_ids", "ids_crc32", "round_trip")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image is drawn from every usable vector; a turned, scaled or cropped copy, with other brightness and noise, of each vec_id divisible by 50 is searched for."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), "embedding")
    images = rows.select("id", media.drawn(F.col("embedding")).alias("image"))
    asked = rows.where(F.col("id") % 50 == 0).select("id", media.edited(media.drawn(F.col("embedding"))).alias("image"))
    return media.copies(images, asked)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)))
    scored = langid.with_language(docs.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~in_fold(F.col("doc_id"), 3, 1)))
    scored = quality.with_quality(docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", in_fold(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    return hmm.language_model(docs)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

OP12_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

OP13_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
), each AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS m, any_value(b.n) AS k
    FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2
), links AS (SELECT x, y FROM shared WHERE 100 * common >= 85 * (m + k - common)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT b.y, w.root FROM walk w JOIN both_ways b ON b.x = w.node AND w.root < b.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT node, min(root) AS component_id FROM walk GROUP BY node) c ON c.node = s.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_media": op4_media,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_hmm": op7_hmm,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_topk": op10_topk,
    "op11_whitening": op11_whitening,
    "op12_fim": op12_fim,
    "op13_jaccard": op13_jaccard,
}

ORACLE_SQL: dict[str, str] = {"op10_topk": OP10_SQL, "op12_fim": OP12_SQL, "op13_jaccard": OP13_SQL}
