"""Exact duplicates by digest, with frequent digests taken apart from the rest.

A Misra-Gries summary per partition finds every digest that may hold a large share of the rows.
Their groups are counted in a map-side aggregation and their winners are broadcast, so a text with
a third of all rows never meets in one task. What is left has only small groups and is joined by
an ordinary shuffle.

Defined results: a NULL text counts as empty. Rows that repeat a doc_id are copies of each other
like any others and share their decision. A row without doc_id never wins while its group has a
row with one; if none has, keep_id is NULL and the rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm import workers
from flowlens.llm.tables import materialize, rows_that_stay, texts

COUNTERS = 256  # of one summary; a digest with 2 / (COUNTERS + 1) of the rows is always found


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; NULL as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text as 32 bytes."""
    rows = texts(documents)
    return rows.select("doc_id", F.unhex(F.sha2(normalised(rows["text"]), 256)).alias("digest"))


def _summary(k: int):
    """Misra-Gries over a partition: batches are counted, merged, and cut back to k counters by
    subtracting the count at rank k + 1, which is what as many single decrements would do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            fresh = pc.value_counts(batch.column(0))
            fresh = pa.table({"digest": fresh.field(0), "n": fresh.field(1)})
            held = pa.concat_tables([held, fresh]).group_by("digest").aggregate([("n", "sum")])
            held = held.rename_columns(["digest", "n"])
            if held.num_rows > k:
                held = held.take(pc.sort_indices(held, [("n", "descending")]))
                less = held.column("n")[k]
                held = held.slice(0, k)
                held = held.set_column(1, "n", pc.subtract(held.column("n"), less))
                held = held.filter(pc.greater(held.column("n"), 0))
        yield from held.combine_chunks().to_batches()

    return workers.lean(run)


def frequent_digests(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k + 1 digests, among them every one with 2 / (k + 1) of the rows or more.

    A partition's counter falls short by at most its rows / (k + 1), so the sum of a digest's
    counters falls short by at most N / (k + 1). Sums of N / (k + 1) or more number k + 1 at most,
    as all counters together hold no more than N.
    """
    total = rows.count()
    parts = rows.select("digest").mapInArrow(_summary(k), "digest binary, n bigint")
    return (
        parts.groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") * (k + 1) >= total) & (F.col("n") > 1))
        .select("digest")
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def exact_groups(documents: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digests(documents))
    # Exact counts and winners of the candidates: k + 1 rows at most, hence the broadcasts.
    heavy = materialize(_groups(rows.join(F.broadcast(frequent_digests(rows, k)), "digest", "left_semi")))
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    found = rows.join(F.broadcast(heavy), "digest").unionByName(rest.join(_groups(rest), "digest"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The documents that stay, with their columns: of equal texts the rows with the smallest id.
    Rows that repeat both id and text stay or go together; of an id with several texts only the rows
    go whose text has a smaller id. Rows without doc_id stay."""
    decided = exact_groups(documents, k).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return rows_that_stay(
        documents, decided, lambda rows, name: rows.withColumn(name, F.sha2(normalised(rows["text"].cast("string")), 256))
    )
