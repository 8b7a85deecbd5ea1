"""Queries of the corpus operators, one opN_<name> each, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, jaccard, merkle, secrets, spelling, spm, suffixes, suffixtrees, tokenfiles, toxicity, urlfilter, warc
from .common import table, written


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.build_archives(warc.plan_records(table(spark, sf_dir, "pages"))), "warc")
    return warc.read_archives(archives, payloads=False).drop("url")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "position", "same_values")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return spm.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity.rate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", F.coalesce(toxicity.fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtrees.remove_repeats(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
#: How SQL puts op3: the archive's round trip must give back what the pages say.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS n, t, max(page_id) OVER (PARTITION BY t) AS kept FROM p)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to
FROM q
"""

SQL = {
    "op1_suffix_array_dedup": suffixes.SQL,
    "op5_embedding_near_dedup": embeddings.SQL,
    "op2_secret_scan": secrets.SQL,
    "op3_warc": WARC_SQL,
    "op6_ngram_jaccard_join": jaccard.SQL,
    "op7_url_filter": urlfilter.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_substring_dedup": suffixtrees.SQL,
    "op13_spelling_variants": spelling.SQL,
}
