"""The corpus pipeline: each stage works on all documents that its predecessor kept, written as Parquet and read back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelspan.llm import decontam, jaccard, secrets, spm, toxicity
from reelspan.llm.common import table, written


#: Rows of a batch that goes to a Python worker. Documents are long; with Spark's 10,000 a task holds tens of megabytes on either side.
BATCH, SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Lower the session's batches for what follows; smaller ones stay."""
    if not 0 < int(spark.conf.get(SETTING)) <= BATCH:
        spark.conf.set(SETTING, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labels outside the held-out fold, doesn't call toxic."""
    in_small_batches(spark)
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar pairs connect."""
    in_small_batches(spark)
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch of a benchmark item, re-parameterised or not."""
    in_small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with their digest and whether decoding gives the text back."""
    in_small_batches(spark)
    return spm.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]
#: SQL can't express the first and the last stage; the tests hold each stage's operator against a brute-force version or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
