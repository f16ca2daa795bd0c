"""Corpus pipeline: quality rules, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its
predecessor kept, and is written as Parquet and read again before the next.
All but the last return the columns of ``documents``.

Defined cases: a null, empty or letterless text does not pass the quality rules
(too few words), so no later stage sees one; a very long text is judged whole in
each stage.  Rows that repeat an id go through the first two stages one by one;
of those that are left the near-duplicate stage keeps one, the one with the
smallest text (then language, source and length).  Rows without an id are never
taken for each other's copies.  Extra columns of the input are dropped, whatever
their names.  An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutriyield.llm import language_bits, length_buckets, near_dups, quality_lines
from nutriyield.llm.common import shared_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a document below this corrected share of known n-grams is in none of the learned languages
MIN_LANGUAGE_SCORE = 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a rule."""
    # the rules return only what they read, so lang and source ride inside the id column
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    kept = quality_lines.clean_lines(rows, id_col="row").where("kept")
    return kept.select("doc_id.doc_id", F.col("cleaned_text").alias("text"), "doc_id.lang", "doc_id.source",
                       F.length("cleaned_text").cast("bigint").alias("n_chars"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go; lang becomes the prediction. All documents with a language are learned from."""
    filters = language_bits.learn(docs)
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    found = language_bits.identify(rows, filters, id_col="row")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select("doc_id.doc_id", "doc_id.text", F.col("lang_pred").alias("lang"), "doc_id.source", "doc_id.n_chars")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class of op9 (two-word shingles) stays: the one with the smallest id, once."""
    classes = near_dups.near_duplicates(docs, shingle=2)
    gone = classes.where("not kept").select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti")
    # rows that repeat an id are copies of one node: keep the smallest of them; rows without an id can't be told apart and stay
    again = shared_table(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if again.isEmpty():
        return stay.select(*COLUMNS)
    once = stay.join(again, "doc_id", "left_anti")
    row = F.struct(*COLUMNS[1:])
    first = stay.join(again.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return once.unionByName(first).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return length_buckets.pack_buckets(docs)


STAGES = [("quality rules", quality_stage), ("language ID", language_stage), ("near duplicates", dedup_stage), ("packing", packing_stage)]

#: language ID and near-duplicate classes aren't SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage{k}")
    return docs
