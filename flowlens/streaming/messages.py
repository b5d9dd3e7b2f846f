"""Streams of messages: texts taken apart into rows, control messages and what can't be read; and Q2
where both of its inputs arrive as messages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowlens.operators.joins import with_bank_name
from flowlens.operators.projection import project_to
from flowlens.schema import RESULTS
from flowlens.sources.envelopes import HEADER, parse_envelopes
from flowlens.streaming.live import SHORT_RUN_CONF, Tally, completed
from flowlens.streaming.replays import drop_repeats
from flowlens.streaming.runs import committed, of_batch, run

CONTROL, QUARANTINED = "control", "quarantined"


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The lines of the text files of a folder as they arrive, in the column `value`."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def _row(schema: T.StructType, text: Column) -> Column:
    return F.from_json(text, schema)


def envelope_parts(lines: DataFrame, rows: Mapping[str, T.StructType], column: str = "value") -> dict[str, DataFrame]:
    """Messages taken apart: the rows of each type in `rows` by its name, with client, sender and
    msg_id; valid messages of all other types as `control`; and `quarantined`, the header as far as it
    can be read and the text. Every message is in one of them. A message with anything but objects in
    its batch is not valid. Fields that don't fit a row's schema are NULL."""
    # the header once for all types; a row's text is read by the schema of its type
    parsed = parse_envelopes(lines, T.StringType(), column)
    objects = F.forall("payload.batch", lambda text: F.coalesce(F.ltrim(text).startswith("{"), F.lit(False)))
    judged = parsed.withColumn("valid", F.col("valid") & F.coalesce(objects, F.lit(True)))
    good, parts = judged.where("valid"), {}
    for kind, schema in rows.items():
        fields = F.transform("payload.batch", partial(_row, schema))
        parts[kind] = good.where(F.col("type") == kind).select("client", "sender", "msg_id", F.inline(fields))
    parts[CONTROL] = good.where(~F.col("type").isin(*rows)).select(*HEADER)
    parts[QUARANTINED] = judged.where(~F.col("valid")).select(*HEADER, F.col(column).alias("text"))
    return parts


def envelope_stream(lines: DataFrame, folder: str, rows: Mapping[str, T.StructType], column: str = "value") -> dict[str, DataFrame]:
    """Runs a stream of message texts into the tables of `envelope_parts`, from one pass and with all
    tables of a micro-batch or none of them. Each has the number of its micro-batch as `batch`."""
    run(lines, folder, lambda batch, _: envelope_parts(batch, rows, column), atomic=True)
    parts = envelope_parts(lines, rows, column)
    return {name: committed(lines.sparkSession, folder, name, df.schema) for name, df in parts.items()}


PAYMENTS, ACCOUNTS = "payments", "accounts"
_BOTH = Tally(keys=("input", "bank", "bank_name"), largest="amount", named_by="account")


def _messages(stream: DataFrame, which: str, bank: str, name: str | None, amount: str | None, account: str | None) -> DataFrame:
    def text(column: str | None):
        return (F.lit(None) if column is None else F.col(column)).cast("string")

    return stream.select(
        "client_id", "type", F.concat(F.lit(f"{which}/"), "sender").alias("sender"), "msg_id",
        F.lit(which).alias("input"), text(bank).alias("bank"), text(name).alias("bank_name"),
        (F.lit(0.0) if amount is None else F.col(amount).cast("double")).alias("amount"), text(account).alias("account"),
    )


def named_maxima_of_two(payments: DataFrame, accounts: DataFrame, folder: str, markers: int = 2) -> T.StructType:
    """Q2 per client over two streams of messages, both with client_id, type, sender and msg_id. What
    comes first waits: a client's answer is given in the micro-batch in which its last end marker comes,
    by whichever stream that is, with all names and payments until then. `markers` is the number of end
    markers of both streams together. Markers and rows delivered again are dropped by stream, sender and
    number. A tombstone in either stream takes what both have brought.

    State is a row per bank and one per bank's name, not the payments. Answers are in
    ``folder/rows/batch=<number>``, read by `runs.numbered` with the schema returned.
    """
    both = _messages(payments, PAYMENTS, "from_bank", None, "amount_paid", "from_account").unionByName(
        _messages(accounts, ACCOUNTS, "bank_id", "bank_name", None, None)
    )
    groups = completed(drop_repeats(both), _BOTH, markers)

    def branches(batch: DataFrame, number: int) -> dict[str, DataFrame]:
        # read back, since two looks at the batch would run its state twice
        batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")
        return {"rows": _named(of_batch(batch.sparkSession, folder, "groups", groups.schema, number))}

    run(groups, folder, branches, conf=SHORT_RUN_CONF)
    return _named(groups.sparkSession.createDataFrame([], groups.schema)).schema


def _named(groups: DataFrame) -> DataFrame:
    largest = groups.where(F.col("input") == PAYMENTS).select(
        "client_id", F.col("bank").alias("from_bank"), F.col("account").alias("from_account"), F.col("amount").alias("amount_paid")
    )
    names = groups.where(F.col("input") == ACCOUNTS).select("client_id", F.col("bank").alias("bank_id"), "bank_name")
    by = ["client_id"]
    return project_to(with_bank_name(largest, names, by, small_rows=None), RESULTS["q2"], by)
