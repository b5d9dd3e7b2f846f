"""Dropping messages that are delivered again, by client, sender and message number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.streaming.runs import BatchBranches, of_batch

KEY = ("client_id", "sender", "msg_id")


def drop_repeats(
    df: DataFrame, key: Sequence[str] = KEY, watermark: tuple[str, str] | None = None
) -> DataFrame:
    """First delivery of each message, for batches and streams. A message without sender or
    number cannot be recognised and always passes, without leaving state behind.

    On a stream the keys seen are kept as state; `watermark` (column, delay) bounds it.
    """
    known = df.where(_complete(key))
    if watermark is not None:
        known = known.withWatermark(*watermark).dropDuplicatesWithinWatermark([*key])
    else:
        known = known.dropDuplicates([*key])
    return known.unionByName(df.where(~_complete(key)))


def _complete(key: Sequence[str]) -> Column:
    sender, number = F.col(key[-2]), F.col(key[-1])
    return sender.isNotNull() & number.isNotNull()


def above_high_mark(
    df: DataFrame,
    arrival: str,
    key: Sequence[str] = KEY,
    block: int = 1_000_000,
    marks: DataFrame | None = None,
) -> DataFrame:
    """Rows whose number exceeds every earlier one of their client and sender, `marks` (with
    a column `top`) holding those of earlier batches.

    A running maximum in order of `arrival`, in two levels: within blocks of arrival numbers
    and over the maxima of the blocks. A sender with most of the rows is thereby spread
    over as many tasks as it has blocks.
    """
    *who, number = key
    known = df.where(_complete(key)).withColumn("_block", F.floor(F.col(arrival) / block))
    maxima = known.groupBy(*who, "_block").agg(F.max(number).alias("_top"))
    if marks is not None:
        first = marks.select(*who, F.lit(None).cast("long").alias("_block"), F.col("top").alias("_top"))
        maxima = maxima.unionByName(first)
    earlier = Window.partitionBy(*who).orderBy(F.col("_block").asc_nulls_first())
    before = F.max("_top").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    blocks = maxima.select(*who, "_block", before.alias("_before")).where("_block IS NOT NULL")
    inside = Window.partitionBy(*who, "_block").orderBy(arrival)
    so_far = F.max(number).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = known.join(blocks, [*who, "_block"]).withColumn("_in_block", so_far)
    mark = F.greatest("_before", "_in_block")
    fresh = marked.where(mark.isNull() | (F.col(number) > mark)).select(*df.columns)
    return fresh.unionByName(df.where(~_complete(key)))


def high_mark_branches(arrival: str, folder: str, key: Sequence[str] = KEY, block: int = 1_000_000) -> BatchBranches:
    """`above_high_mark` batch by batch, for `runs.run`: fresh rows go to the branch `rows`,
    and the marks to the branch `marks`, from where the next batch takes them. Both are
    files of their batch, so a repeated batch starts from the same marks."""
    *who, number = key

    def branches(batch: DataFrame, n: int) -> dict[str, DataFrame]:
        top = batch.where(_complete(key)).groupBy(*who).agg(F.max(number).alias("top"))
        before = of_batch(batch.sparkSession, folder, "marks", top.schema, n - 1)
        marks = top.unionByName(before).groupBy(*who).agg(F.max("top").alias("top"))
        return {"rows": above_high_mark(batch, arrival, key, block, before), "marks": marks}

    return branches
