"""The corpus pipeline: language ID, near-dedup, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result as
Parquet in the shared folder and reads it again for the next; what the stage
held for that is let go of then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.llm import bpe, langid, mixing, near_dup, secrets
from basaltiq.llm.common import bounded_batches, holding, let_go, scratch, table
from basaltiq.llm.queries import tokenizer


#: bits a byte; clean texts stay below 9, bytes that no learned language has cost some 20
MOST_BITS = 10.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: those that the model calls und (null, or without a letter), and those whose code is longer than MOST_BITS a byte in every learned language.

    The trees are learned from the labelled texts of docs. Others keep their row, with lang as predicted where it was null; a given lang stays. Without a labelled text nothing is learned and only und texts go. Repeated rows are judged each; an empty table gives no rows.
    """
    bounded_batches(spark)
    model = langid.fit(docs)
    # one language a row: predicted from the row's own text, beside the row
    shared = spark.sparkContext.broadcast(model)
    import pyarrow as pa
    import pyarrow.compute as pc

    at, named = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            lang, _, rate = langid.labelled(shared.value, batch.column(at))
            stays = pa.array([g != langid.UND and r <= MOST_BITS for g, r in zip(lang, rate)], pa.bool_())
            if not shared.value.langs:
                lang = [None] * len(lang)
                stays = pc.fill_null(pc.match_substring_regex(batch.column(at), r"\p{L}"), False)
            columns = list(batch.columns)
            columns[named] = pc.coalesce(columns[named], pa.array(lang, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(stays)

    return docs.mapInArrow(run, docs.schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id.

    Rows with null id or null text stay; of rows with equal id and text one stays; of an id with several texts only copies go.
    """
    bounded_batches(spark)
    return near_dup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; n_chars follows. Every row stays, repeated ones too; null texts stay null, with null n_chars."""
    bounded_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of the drawn blocks: a document's row for each epoch that takes any of it, whole where all its blocks are taken; n_chars follows.

    Null and empty texts have no words to draw and don't appear; repeated rows are documents each; an empty table gives no rows.
    """
    bounded_batches(spark)
    return mixing.remix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, a row for each row; null text is empty."""
    bounded_batches(spark)
    return bpe.digests(docs, *tokenizer())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    others = holding()
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        let_go(but=others)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
