"""A corpus from documents to token ids: five stages, each written as Parquet and read again by the next.

quality classifier -> SimHash near-dedup -> substring dedup -> mixing to target weights -> byte-level BPE.
Every stage works on all rows its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amendry.llm.byte_bpe import encode_and_decode
from amendry.llm.lempel_ziv import without_repeated_windows
from amendry.llm.quality_model import fit_attention_model, kept_by_quality
from amendry.llm.queries import table, tokenizer
from amendry.llm.scratch import beside, written
from amendry.llm.simhash import similar_groups
from amendry.llm.soft_mixing import mixed, mixing_rates

#: Of the expected tokens of each language: shares are evened out, and none shrinks.
TEMPER = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model, fitted on the labelled ones, scores 0.7 or more."""
    return kept_by_quality(docs, fit_attention_model(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a Jaccard similarity of 0.8 or more of five-word
    shingles; pairs are proposed by SimHash fingerprints at common anchors. Rows without id stay; where rows share an id,
    each goes or stays by its own text, one text of a group under its least id stays, and of rows with equal id and text one."""
    own, mark, nth = beside(docs.columns, "own", "mark", "nth")
    groups = similar_groups(docs, similarity=0.8, width=5).withColumn("gone", F.expr("doc_id <> component_id OR mark <> component_mark"))
    keys = groups.groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark)).agg(F.first("gone").alias("gone"), F.count(F.lit(1)).alias("times"))
    keys = written(keys.where("gone OR times > 1"), "gone")  # its size is known when the join is planned
    same = (F.col("doc_id") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark))
    kept = docs.join(keys.select(own, mark), same, "left_anti").select(*docs.columns)
    repeated = keys.where("NOT gone").select(own, mark)
    if repeated.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(own, mark).orderBy(F.xxhash64(*docs.columns)))
    return kept.union(docs.join(repeated, same).withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 13 words that an earlier one holds; n_chars follows the text."""
    return without_repeated_windows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates; the domains are the languages of the documents that `labels` names."""
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return mixed(docs, mixing_rates(docs, labelled, "lang", temper=TEMPER))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to."""
    return encode_and_decode(docs, *tokenizer(), keep_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mixing),
    ("byte-level BPE", encode),
]

#: Fitted models and the tokenizer have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
