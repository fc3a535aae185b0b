"""Corpus pipeline: language, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on everything the stage before it kept, and is written as Parquet and
read again before the next one. All but the last return the columns of documents. Rows are told apart by doc_id and
text; rows equal in both go or stay together, except that the exact stage keeps one of them. Null and empty texts have
no letters and go in the first stage. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailies.llm import langid, minmax, naming, pieces, winnowing
from dailies.llm.common import join_keyed
from dailies.session import ensure_checkpoint_dir


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, so that no column of theirs can clash, beside the key of the operators."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a letter: predict gives 'und' only for texts without one.

    The model is fitted on a bounded sample of the documents that name their language, but neither the language it
    finds nor its score rejects a document; letters in no learned language pass.
    """
    model = langid.train(docs)
    if model is None:  # no document names a language: only texts without a letter can be told from the others
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = langid.predict(docs, model, keep=tuple(docs.columns), named=("__lang_pred", "__score"))
    return found.filter("__lang_pred <> 'und'").drop("__lang_pred", "__score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group of equal texts."""
    return naming.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts that share four fifths of their five-word shingles."""
    stay = minmax.near_duplicates(docs, shingle=5, percent=80).filter("stays").select("doc_id", "h").distinct()
    return join_keyed(_rows(docs), stay).select("row.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any ten consecutive words of a benchmark item."""
    found = winnowing.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=10, keys=True).filter("contaminated")
    return join_keyed(_rows(docs), found.select("doc_id", "h").distinct(), "left_anti").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, their number, and whether decoding gives the text back."""
    texts = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("given", F.sha2("text", 256))
    keep = ("doc_id", "lang", "source", "given")
    back = pieces.decode(pieces.encode(texts, keep=keep), keep=(*keep, "ids"))
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), (F.sha2("text", 256) == F.col("given")).alias("same_text"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("token_ids", token_ids)]

#: Neither the language model nor the segmentation can be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; results between them go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
