"""Reading the input tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import materialize

__all__ = ["materialize", "table", "texts", "fold_of", "unused_name", "rows_that_stay"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000  # of documents handed to Python at once


def in_small_batches(documents: DataFrame) -> DataFrame:
    """Documents are long: with Spark's own 10,000 rows, every task holds tens of megabytes of one
    batch in the JVM and again in Python. Unless the session was given a number of its own, it gets a
    smaller one. Results don't depend on it."""
    conf = documents.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return documents


def texts(documents: DataFrame) -> DataFrame:
    """(doc_id bigint, text string) of a documents table, whatever else it holds. A missing text
    stays NULL, a missing id too."""
    in_small_batches(documents)
    return documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"),
        documents["text"].cast("string").alias("text"),
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a row without an id falls in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def unused_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_that_stay(documents: DataFrame, decided: DataFrame, digested: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The documents whose row was decided to stay, with their columns.

    `decided` has (doc_id, digest, kept) for every row. An id all of whose rows share a decision is
    enough to tell them by. Only rows whose id is among both kinds are told by their digest too,
    which `digested` adds to them as a column of the given name. Rows without doc_id stay.
    """
    decided = materialize(decided.where(F.col("doc_id").isNotNull()))
    per_id = decided.groupBy("doc_id").agg(F.min("kept").alias("all_stay"), F.max("kept").alias("some_stay"))
    leaving = materialize(per_id.where(~F.col("all_stay")))
    name = unused_name(documents, "gone_id")
    whole = documents["doc_id"].cast("bigint")
    out = documents.join(leaving.select(F.col("doc_id").alias(name)), whole == F.col(name), "left_anti")
    mixed = leaving.where("some_stay").select(F.col("doc_id").alias(name))
    if mixed.isEmpty():
        return out
    digest = unused_name(documents, "gone_digest")
    told = digested(documents.join(mixed, whole == F.col(name), "left_semi"), digest)
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias(name), F.col("digest").alias(f"{digest}_of"))
    same = (told["doc_id"].cast("bigint") == F.col(name)) & (told[digest] == F.col(f"{digest}_of"))
    return out.unionByName(told.join(gone, same, "left_anti").drop(digest))
