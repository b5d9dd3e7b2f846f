"""Rows packed in JSON batch messages: ``{"type", "client", "sender", "msg_id", "eof",
"payload": {"batch_size", "batch": [row, ...]}}``, one message per line or cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Message types that must carry a batch.
BATCH_TYPES = (
    "raw_transactions",
    "raw_accounts",
    "q1_result",
    "q2_result",
    "q3_result",
    "q4_result",
    "q5_result",
)
END_TYPE = "eof"
CANCEL_TYPE = "delete_client"

HEADER = ("type", "client", "sender", "msg_id", "eof")


def envelope_schema(row: T.StructType) -> T.StructType:
    text = T.StringType()
    payload = T.StructType().add("batch_size", T.IntegerType()).add("batch", T.ArrayType(row))
    return (
        T.StructType()
        .add("type", text)
        .add("client", text)
        .add("sender", text)
        .add("msg_id", T.LongType())
        .add("eof", T.BooleanType())
        .add("payload", payload)
    )


def parse_envelopes(df: DataFrame, row: T.StructType, column: str = "value") -> DataFrame:
    """Header fields, `payload`, the text itself and whether the message is `valid`: it has
    a type, and a batch type has a payload whose batch_size is the length of its batch."""
    parsed = df.withColumn("_m", F.from_json(F.col(column), envelope_schema(row)))
    fields = parsed.select("*", *(F.col(f"_m.{h}").alias(h) for h in HEADER), "_m.payload")
    return fields.drop("_m").withColumn("valid", _valid())


def _valid() -> Column:
    typed = F.coalesce(F.trim("type") != "", F.lit(False))
    sized = F.col("payload.batch_size") == F.size("payload.batch")
    has_batch = F.coalesce(F.col("payload.batch").isNotNull() & sized, F.lit(False))
    return typed & (~F.col("type").isin(*BATCH_TYPES) | has_batch)


def envelope_rows(messages: DataFrame, message_type: str) -> DataFrame:
    """Flat rows of the valid messages of one type, with client, sender and msg_id."""
    good = messages.where(F.col("valid") & (F.col("type") == message_type))
    return good.select("client", "sender", "msg_id", F.inline("payload.batch"))


def quarantined(messages: DataFrame) -> DataFrame:
    """Messages that are not valid, whole, for inspection."""
    return messages.where(~F.col("valid"))
