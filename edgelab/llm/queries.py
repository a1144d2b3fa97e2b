"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common, decontamination, embeddings, jaccard, langid, licences, quality, sentencepieces, token_orc, toxicity, warc

BYTE_BPE, PIECES, END_ID = "byte_bpe_50k.json", "piece_bpe_32k.model", 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = common.fresh_path(spark, "warc")
    warc.write_archive(common.table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item."""
    ship(spark)
    return decontamination.find_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _decided(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(common.fold("doc_id", folds) == held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    documents = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, common.table(spark, sf_dir, "labels"), 3, 1)
    return _decided(toxicity.score(documents, model, ["doc_id"]), 3, 1)


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = common.fresh_path(spark, "tokens")
    token_orc.write_token_orc(common.table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE), END_ID)
    return token_orc.read_token_index(spark, path)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    documents = common.table(spark, sf_dir, "documents")
    model = quality.fit(documents, common.table(spark, sf_dir, "labels"), 4, 2)
    return _decided(quality.score(documents, model, ["doc_id"]), 4, 2)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.join_components(common.table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    documents = common.table(spark, sf_dir, "documents")
    found = langid.predict(documents, langid.fit(documents, 3, 1), ["doc_id"])
    return found.select("doc_id", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "bits")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of pieces, the crc32 of their ids, and whether decoding gives the text again."""
    ship(spark)
    return sentencepieces.encode(common.table(spark, sf_dir, "documents"), tokenizer_path(PIECES), ["doc_id"], with_ids=False)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embeddings.near_duplicates(common.table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_toxicity, op4_token_orc, op5_quality, op6_jaccard_join, op7_licences, op8_language_id, op9_sentencepiece, op10_embedding_dedup)}

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS nth FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
CASE WHEN payload_bytes >= 100 AND nth > 1 AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_id END AS refers_to FROM f""",
    "op7_licences": licences.scan_sql("documents"),
    # All pairs of equal label, compared in double precision.
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
good AS (SELECT * FROM n WHERE norm > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON vec_id = comp.a LEFT JOIN counted ON vec_id = counted.a""",
}
