"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, exact, mixture, negatives, ngram, pieces, privacy, simhash, suffixes, tokenfiles, toxicity, turns, warc
from loomlog.llm.common import staging_path

#: Key of the test queries; real runs pass their own secret.
SURROGATE_KEY = "test-key"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder).withColumnRenamed("kind", "record_type")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return found.filter("record_type <> 'gap'").select(*columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "ids")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tokenfiles.write_ids(table(spark, sf_dir, "documents"), folder, vocabulary)
    return tokenfiles.read_ids(spark, folder)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode(table(spark, sf_dir, "documents"), model, keep_ids=False)
    return found.select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    kinds = [F.expr(f"size(filter(entities, e -> e.kind = '{kind}'))").alias(f"n_{kind}") for kind in privacy.KINDS]
    return found.select("doc_id", F.size("entities").alias("n_entities"), *kinds, "text")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damaged(conversations), conversations, "times")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_token_ids": op7_token_ids,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_turn_repair": op11_turn_repair,
    "op12_source_mix": op12_source_mix,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""",
    "op5_warc": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), g AS (
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
           max(page_id) OVER (PARTITION BY sha1(html)) AS latest
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM g
""",
    "op13_hard_negatives": """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM r a, r WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
}
