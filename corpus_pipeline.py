"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read again as the next one's input.

Stages return the columns of their input, whatever their names. A row is judged by its own text: rows of one doc_id with
different texts have verdicts of their own. A null or empty text has no language and ends in the first stage, if there is
one to learn; an empty table gives an empty table. The last stage returns the encoded documents. ``run`` applies all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import bpe, decontam, grade, jaccard, langid
from skytally.llm.common import remainder, stage, table

LEAST_SCORE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """The row as one column, so that no column's name can clash with those of an operator, and a hash of its text.

    Near duplicates and contamination depend on the text alone, so their verdicts travel by that hash: rows that share a
    doc_id are judged each by its own text, and a doc_id can be of any type or missing.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.xxhash64("text").alias("__key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known go on; all of them if no language can be learned."""
    model = langid.train(docs.where(remainder("doc_id", 5) != 0))
    if model is None:
        return docs
    told = langid.predict(_packed(docs).select("__row"), model, text="__row.text", keep=("__row",))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good and not toxic than not go on."""
    model = grade.train(docs, table(spark, sf_dir, "labels"), grade.quality_and_toxicity())
    return grade.grade_documents(_packed(docs).select("__row"), model, keep=("__row",), text="__row.text").where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id goes on, once; those without words all do."""
    rows = _packed(docs)
    groups = jaccard.similar(rows.select("__key", F.col("__row.text").alias("text")), key="__key")
    # Read three times below: without the table each reading would plan and run the end of the operator again.
    groups = stage(groups.where("n_shingles > 0").select("__key", F.col("component_id").alias("__group")).distinct(), "groups")
    order = F.struct(F.col("__row.doc_id").isNull().alias("none"), F.col("__row.doc_id").alias("id"), "__key")
    first = rows.select(order.alias("__order"), "__key").join(groups, "__key").groupBy("__group").agg(F.min("__order").alias("o"))
    first = first.select(F.col("o.id").alias("__id"), F.col("o.__key").alias("__key"))
    grouped = rows.join(groups.select("__key"), "__key", "left_semi")
    winners = grouped.join(first, (grouped["__key"] == first["__key"]) & grouped["__row.doc_id"].eqNullSafe(first["__id"]), "left_semi")
    alone = rows.join(groups.select("__key"), "__key", "left_anti")
    once = winners.withColumn("__id", F.col("__row.doc_id")).dropDuplicates(["__key", "__id"])
    return once.select("__row.*").unionByName(alone.select("__row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item go on."""
    rows = _packed(docs)
    found = decontam.decontaminate(rows.select("__key", F.col("__row.text").alias("text")), table(spark, sf_dir, "benchmark"), key="__key")
    return rows.join(found.where("contaminated").select("__key"), "__key", "left_anti").select("__row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the decoded text."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and byte-pair merges are not expressible in SQL; tests/llm compares with a plain chain of the stages.
ORACLE_SQL = None
