"""A training-corpus pipeline over the documents table, in five stages.

language    drops texts without a letter, and those no language's regression claims (score below MIN_SCORE)
near_dedup  keeps one document (the least id) of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more:
            SimHash fingerprints over the Gray-order index propose links, an exact join of shingles finds those beyond their radius
decontaminate  drops documents that hold a window of a benchmark item
pii         replaces personal data in texts by its kind
encode      gives the piece ids of each text, and the text decoded from them

Each stage is written as Parquet in the shared folder and read again for the next.  near_dedup
works on rows: of a component's rows with the least doc_id it keeps the one of least hash over all columns; a row without doc_id stays
where no other of its component has one; rows of equal doc_id but different texts are different documents.  decontaminate judges each text by itself.  ORACLE_SQL is None: the stages are not
expressible in SQL; tests run them against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm import decontam, langid, neardup, pieces, pii
from lattix.llm.common import fold
from lattix.session import ensure_checkpoint_dir, read_table

MIN_SCORE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(fold("doc_id", 5) != 0), "doc_id", "text", "lang")
    kept = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by text, so that rows without an id, or of an equal one, are judged each by its own text
    docs = docs.select(*COLUMNS).withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    bad = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), doc_id="key").where("n_hit > 0").select("key")
    return docs.join(bad, "key", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.annotate(docs.select(*COLUMNS), redacted_as="redacted")
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode(docs.select("doc_id", "text"), decoded_as="decoded")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.col("decoded").alias("text"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
