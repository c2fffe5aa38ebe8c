"""The training-data pipeline over the documents table.

Language ID drops documents without a recognisable language; line dedup drops lines that an earlier document holds;
SimHash keeps one document of each near-duplicate group; secrets are blanked out; what remains is packed into
sequences. Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import langid, line_dedup, packing, secret_scan, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of the predicted language; words in a shingle and similarity where texts are compared.
LEAST_SCORE, SHINGLE, SIMILARITY = 0.3, 5, 0.8


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go; others stay as they are."""
    model = langid.learn(docs)
    told = langid.classify(docs.select(*COLUMNS), model)
    return told.where(~langid.rejected(F.col("lang_pred"), F.col("score"), LEAST_SCORE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go. A document that loses all of its lines goes with them."""
    out, _ = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    out = out.where((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_dropped") == 0))
    return _as_documents(out.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), F.col("c_lang").alias("lang"), F.col("c_source").alias("source"), F.lit(0).alias("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones stays; of rows that repeat an id the one with the least text."""
    groups = simhash.similar_components(docs, SIMILARITY, SHINGLE)
    gone = groups.where(F.col("component_id") != F.col("id")).select(F.col("id").alias("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    known = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not known.limit(1).count():
        return left
    first = Window.partitionBy("doc_id").orderBy("text", "lang", "source")
    named = left.where("doc_id is not null").withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return named.select(*COLUMNS).unionByName(left.where("doc_id is null"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return _as_documents(secret_scan.redact(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence, ids as unsigned 32-bit integers."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", blank_secrets),
    ("packing", pack_sequences),
]

#: Language ID, randomness tests and tokenizers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
