"""Pipeline stages: ``(spark, docs, sf_dir) -> DataFrame``, each one operator
applied to a table with the columns of ``documents``. Every stage but the
last returns those columns. Rows with a null id or text pass the filters that
cannot judge them; rows that share a doc_id are one document and stay or go
together, but equal texts among them are reduced to one by ``near_duplicates``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dedup, packing, passages, quality
from .scratch import Scratch, few, read_table

#: Similarity of near-duplicates in the pipeline, in percent.
PERCENT = 80


def _without(docs: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the ids of ``gone``. These are saved apart, and the
    operator's tables in ``scratch`` removed: later stages need the disk."""
    gone = few(Scratch(docs.sparkSession, "gone").save(gone.where("doc_id is not null").select("doc_id").distinct()))
    scratch.clear()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, predicts
    to be bad go."""
    scratch = Scratch(spark, "quality")
    scores = quality.quality_scores(docs, read_table(spark, sf_dir, "labels"), scratch)
    return _without(docs, scores.where("predicted = 0"), scratch)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the
    smallest doc_id. Of rows that share a doc_id and a text one stays, also
    where the doc_id is null; of rows that differ in other columns only, always
    the same one. Documents without words are in no group and stay, their
    repeated rows too."""
    scratch = Scratch(spark, "near-dedup")
    found = near_dedup.near_duplicates(docs, scratch, near_dedup.NearDup(percent=PERCENT, bands=75, slack=0.08))
    return _one_row(_without(docs, found.where("not kept"), scratch), scratch)


def _one_row(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One of the rows of ``docs`` with the same doc_id and text. Only rows
    that repeat are moved: their digests are counted first."""
    digest = F.sha2("row.text", 256)
    rows = docs.select(F.struct("*").alias("row"))  # columns of any name and type
    # without words nothing is repeated
    worded = rows.where(F.coalesce(F.col("row.text").rlike("[^\\x09-\\x0D ]"), F.lit(False)))
    keys = worded.groupBy(F.col("row.doc_id").alias("k"), digest.alias("d")).count().where("count > 1").select("k", "d")
    keys = few((scratch or Scratch(docs.sparkSession, "one-row")).save(keys))
    same = F.col("row.doc_id").eqNullSafe(F.col("k")) & (digest == F.col("d"))
    alone = rows.join(keys, same, "left_anti")
    # of rows that differ in other columns the one with the smallest digest of all its values
    one = worded.join(keys, same, "left_semi").groupBy(F.col("row.doc_id").alias("k"), digest.alias("d")) \
        .agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return alone.unionByName(one.select("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that an earlier document holds are cut
    out; n_chars follows the text."""
    out = passages.without_repeats(docs, Scratch(spark, "passages"))
    if "n_chars" not in out.columns:
        return out
    kind = out.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a ``benchmark`` item go."""
    scratch = Scratch(spark, "decontaminate")
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), scratch)
    return _without(docs, found.where("contaminated"), scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in training sequences."""
    return packing.pack_documents(docs, Scratch(spark, "packing"))
