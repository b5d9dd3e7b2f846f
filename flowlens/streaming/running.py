"""Totals per span of time that can be read at any moment, kept by Spark's own aggregation state.

Every micro-batch writes the new totals of the groups it changed. A span's state is let go when the
watermark has passed its end, so state holds the spans of the last `delay` only, however long the
stream runs. What was written stays: a span's last row is its final total.

Nothing is lost unnoticed. A row that comes after its span was let go would not count any more: the
run ends with an error that names their number, in the next micro-batch at the latest. A row
without a time, which belongs to no span, is an error too: set such rows apart before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.streaming.runs import numbered, start

SINCE = "since"


class LateRows(ValueError):
    """Rows came later than the delay that was allowed."""


def _refuse_late(query: StreamingQuery) -> None:
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if dropped:
        raise LateRows(f"{dropped} groups of rows came after their span was let go; start anew with a longer delay")


def totals_stream(
    rows: DataFrame, totals: Mapping[str, Column], time: str, span: str, delay: str, by: Sequence[str] = ()
) -> DataFrame:
    """The stream of totals: `since` (begin of the span), the columns `by` and the `totals`."""
    local = isinstance(rows.schema[time].dataType, T.TimestampNTZType)
    # watermarks are for moments: a time without a zone is taken for UTC, and given back without one
    moment = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(time)).cast("timestamp") if local else F.col(time)
    undated = F.raise_error(F.lit(f"a row without {time}")).cast("timestamp")
    dated = rows.withColumn("_moment", F.coalesce(moment, undated)).withWatermark("_moment", delay)
    spans = dated.groupBy(F.window("_moment", span).alias("_span"), *by).agg(*(c.alias(n) for n, c in totals.items()))
    since = F.col("_span.start")
    if local:
        since = F.convert_timezone(F.current_timezone(), F.lit("UTC"), since.cast("timestamp_ntz"))
    return spans.select(since.alias(SINCE), *by, *totals)


def keep_totals(
    rows: DataFrame, folder: str, totals: Mapping[str, Column], time: str, span: str, delay: str, by: Sequence[str] = ()
) -> T.StructType:
    """Takes in what is available and writes changed totals to ``folder/rows/batch=<number>``; to be
    called again when there is more. Returns their schema."""
    stream, handle = totals_stream(rows, totals, time, span, delay, by), []

    def branches(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        for query in handle:
            _refuse_late(query)
        return {"rows": batch}

    handle.append(start(stream, folder, branches, mode="update"))
    handle[0].awaitTermination()
    _refuse_late(handle[0])
    return stream.schema


def standing(spark: SparkSession, folder: str, schema: T.StructType, by: Sequence[str] = (), at: int | None = None) -> DataFrame:
    """The totals as they stood after micro-batch `at`, or as they stand: each group's last row."""
    rows = numbered(spark, folder, "rows", schema)
    if at is not None:
        rows = rows.where(F.col("batch") <= at)
    names = [n for n in schema.names if n not in (SINCE, *by)]
    last = rows.groupBy(SINCE, *by).agg(F.max_by(F.struct(*names), "batch").alias("_last"))
    return last.select(SINCE, *by, *(F.col("_last")[n].alias(n) for n in names))
