"""A training-data pipeline over the table documents: stages that each take and return its columns, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm._common import forget, fresh, materialize, named, read_table
from telar.llm.jaccard_join import near_duplicates
from telar.llm.line_dedup import dedup_chunks
from telar.llm.mixing import poisson_mix
from telar.llm.packing import best_fit_pack
from telar.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on `labels` finds toxic go.

    Null and empty texts, rows without doc_id and repeated rows are judged like any: one by one, null and empty ones stay.
    Texts of any length are read whole. An empty table gives an empty one. All columns stay, whatever their names.
    """
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that stand earlier in the table go from the texts; n_chars follows where it is there. Every row stays.

    Null texts stay null, texts all of whose lines go become empty. Repeated rows with equal doc_id and text are treated
    alike; a null doc_id ranks first. Texts of any length are read whole. An empty table gives an empty one. All columns
    stay, whatever their names.
    """
    counter = fresh(docs, "n_removed_lines")
    cut, length = dedup_chunks(docs, counter=counter), {c: F.length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return cut.select(*[F.when(F.col(counter) > 0, length[c]).otherwise(named(c)).alias(c) if c in length else named(c) for c in docs.columns])


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar pairs the one with the smallest doc_id stays.

    Rows without doc_id, or with one that is no integer of 64 bits, stay, and so do null, empty and wordless texts. Repeated
    rows with one doc_id stay or go together. Texts of any length are read whole. An empty table gives an empty one. All
    columns stay, whatever their names.
    """
    gone = near_duplicates(docs).select(F.col("doc_id").alias(fresh(docs, "gone")))
    return docs.join(gone, docs["doc_id"].try_cast("long") == gone[gone.columns[0]], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources have their target shares, in global random order.

    A null source is one of its own; null and empty texts are copied like the rest of their source. Rows with one doc_id,
    or none, have the same number of copies. Texts of any length are copied whole. An empty table gives an empty one. All
    columns stay, whatever their names.
    """
    return poisson_mix(docs, copy=fresh(docs, "copy"), key=fresh(docs, "mix_key")).select(*map(named, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in training sequences, as best_fit_pack states them.

    Null and empty texts have a row without a place; repeated rows are packed one by one; long texts are cut. An empty
    table gives an empty result. Other columns are left out.
    """
    return best_fit_pack(docs, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: A machine fitted to labels has no SQL; tests/llm/test_pipeline.py states the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's result written to the shared folder for the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
