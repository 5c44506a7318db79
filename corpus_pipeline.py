"""The corpus pipeline: from raw documents to packed training sequences.

Every stage but the last returns the columns of ``documents`` (doc_id, text, lang, source, n_chars). What the stages do
with odd rows is said in their operators' docstrings; null texts have no language and leave at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import language, neardup, packing, secrets, substrings
from causeway.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle of the near-duplicate stage; similar means 80 % of the union.
SHINGLE = 5
#: Words that a passage must have to be removed where it repeats, and words of its seeds.
PASSAGE, PASSAGE_SEED = 50, 16


def shaped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their predicted language as ``lang``; texts without letters and texts that no learned language codes well go."""
    found = language.identify(docs.select(*COLUMNS), language.fit(docs))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= language.REJECT_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, once; of rows that share it, the one whose text
    has the least hash. Rows without an id stay."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), k=SHINGLE).filter("kept").select("doc_id").distinct()
    first = F.min(F.struct(F.xxhash64("text").alias("h"), *[c for c in COLUMNS if c != "doc_id"]))
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("one"))
    return one.select("doc_id", "one.*").select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE`` words or more that a document with a smaller id has; a text of nothing else goes."""
    cut = substrings.dedup_substrings(docs, PASSAGE, PASSAGE_SEED, carry=("lang", "source"))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return shaped(left.withColumn("text", F.col("kept_text")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mask in place of each secret; no document goes."""
    return shaped(secrets.redact(secrets.scan_secrets(docs.select(*COLUMNS))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("repeated passages", remove_repeats),
    ("secret redaction", redact_secrets),
    ("packing", pack_sequences),
]
#: Context trees and bin packing have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
