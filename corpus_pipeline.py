"""A corpus from documents to training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radarq.llm import common as C
from radarq.llm import decontaminate, line_dedup, near_duplicates, packing, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _stage(f: Stage) -> Stage:
    """Tables that the stage before left in the shared folder go, as its result has been written by now."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.drop_tables(spark, _left)
        with C.recording(_left):
            return f(spark, docs, sf_dir)

    return run


def _bundled(docs: DataFrame, *but: str) -> DataFrame:
    """doc_id, text and all columns but some as one, so that no name of theirs can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in but)).alias("_row"))


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go, empty and null texts by the share of such examples; all columns stay as they are."""
    scored = toxicity.toxicity(_bundled(docs), C.table(spark, sf_dir, "labels"), keep=("_row",))
    return scored.filter("predicted = 0").select("_row.*").select(*docs.columns)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from texts; n_chars follows. Documents stay, be they empty now; a null text becomes empty."""
    out = line_dedup.dedup_lines(_bundled(docs, "text"), keep=("_row",))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays; rows without a doc_id stay.

    Rows that repeat a doc_id are one document and stay or go together.
    """
    others = near_duplicates.near_duplicates(docs).filter("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, with all rows of their doc_id; rows without one count as one document."""
    bad = decontaminate.contamination(docs, C.table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad")), "left_anti").select(*docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, as op7 gives them."""
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Toxicity by learned examples and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last, which may still read tables of its own."""
    _left.clear()  # a result of an earlier run may not have been read yet
    docs = C.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{C.scratch_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
