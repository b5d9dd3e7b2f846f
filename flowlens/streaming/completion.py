"""Answers that are given once a client's input is complete.

A client ends its input with a number of end markers, or cancels it with a tombstone. Each
micro-batch is pre-aggregated and written as partial rows with its batch number; markers and
tombstones are written next to them. The answer merges the partial rows of the clients that
are complete. A client with most of the rows costs no more than one partial row per group
and batch, and nothing depends on state that a lost executor could take with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.sources.envelopes import CANCEL_TYPE, END_TYPE
from flowlens.streaming.replays import drop_repeats
from flowlens.streaming.runs import numbered, run

Partial = Callable[[DataFrame], DataFrame]
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class CompletedClients:
    """`partial` aggregates rows by client into rows of `schema`; `merge` takes partial rows and the
    complete clients and gives the answer. Messages carry `client`, `kind`, a sender and a number:
    what is delivered again, end markers included, is dropped before it counts. A message without
    sender or number cannot be recognised and always counts."""

    def __init__(
        self,
        folder: str,
        partial: Partial,
        merge: Merge,
        schema: T.StructType | str,
        expected_markers: int = 1,
        client: str = "client_id",
        kind: str = "type",
        sender: str = "sender",
        number: str = "msg_id",
    ):
        if expected_markers <= 0:
            raise ValueError("expected_markers must be positive")
        self.folder, self.partial, self.merge = folder, partial, merge
        self.expected, self.client, self.kind = expected_markers, client, kind
        self.key = (client, sender, number)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _rows(self, messages: DataFrame) -> DataFrame:
        return messages.where(~F.col(self.kind).isin(END_TYPE, CANCEL_TYPE))

    def _branches(self, batch: DataFrame, number: int) -> dict[str, DataFrame]:
        ends = batch.where(F.col(self.kind) == END_TYPE)
        tombstones = batch.where(F.col(self.kind) == CANCEL_TYPE)
        return {
            "partials": self.partial(self._rows(batch)),
            "markers": ends.groupBy(self.client).agg(F.count("*").alias("markers")),
            "tombstones": tombstones.select(self.client).distinct(),
        }

    def run(self, messages: DataFrame) -> None:
        """Takes in what is available; to be called again when there is more."""
        run(drop_repeats(messages, self.key), self.folder, self._branches)

    def answer(self, spark: SparkSession) -> DataFrame:
        """The answer for every client that is complete and not cancelled since."""
        name = T.StructField(self.client, T.StringType())
        markers_schema = T.StructType([name, T.StructField("markers", T.LongType())])
        tombstones = numbered(spark, self.folder, "tombstones", T.StructType([name]))
        cancelled = tombstones.groupBy(self.client).agg(F.max("batch").alias("_cancelled"))

        def live(branch: str, schema: T.StructType) -> DataFrame:
            rows = numbered(spark, self.folder, branch, schema).join(cancelled, self.client, "left")
            kept = F.col("_cancelled").isNull() | (F.col("batch") > F.col("_cancelled"))
            return rows.where(kept).drop("batch", "_cancelled")

        markers = live("markers", markers_schema).groupBy(self.client).agg(F.sum("markers").alias("n"))
        complete = markers.where(F.col("n") >= self.expected).select(self.client)
        partials = live("partials", self.schema).join(complete, self.client, "left_semi")
        return self.merge(partials, complete)
