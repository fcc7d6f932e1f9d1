"""The corpus pipeline: from raw documents to token ids.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and gets what the one before kept. ``run`` applies them to ``documents``, each
stage's result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import bpe, decontaminate, jaccard, quality, substring
from gridspan.llm.common import table, without, written


#: A column of this name would be lost; ``_numbered`` refuses it.
ROW = "_row_of_pipeline"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, written so that the numbers stay: ids may repeat."""
    if ROW in docs.columns:
        raise ValueError(f"documents have a column {ROW}")
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; it learns from the labels outside its held-out fold."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id. Texts without links and rows without an id stay.

    Rows are linked by row, not by id: of rows that repeat an id and a text one
    stays, and an id with two texts loses only the text that is a near copy. In
    a class whose smallest id has several texts, the least digest stays.
    """
    rows = _numbered(docs)
    known = rows.filter("doc_id is not null")
    labels, _ = jaccard.similar(known.select(F.col(ROW).alias("doc_id"), "text"))
    marks = known.select(ROW, "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    marks = marks.join(labels.select(F.col("id").alias(ROW), "component"), ROW, "left")
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "digest"))  # texts without words are never linked
    first = marks.groupBy("component", alone.alias("alone")).agg(F.min(F.struct("doc_id", "digest", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return without(rows, known.select(ROW).join(first, ROW, "left_anti"), ROW).drop(ROW)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start in a smaller id; texts that lose nothing keep their white space."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring.dedup_substrings(docs, carry=others, as_is=True).withColumnRenamed("kept", "text")
    out = cut.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item. Only the rows that have one go: not others of their id, and those without an id too."""
    rows = _numbered(docs)
    found = decontaminate.find_overlaps(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, found.select(F.col("doc_id").alias(ROW)), ROW).drop(ROW)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to: (doc_id, n_tokens, ids, text)."""
    path = bpe.default_vocabulary()
    return bpe.round_trip(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot express the classifier; tests/llm/test_pipeline.py holds the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
