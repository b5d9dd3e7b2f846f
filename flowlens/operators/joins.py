"""Lookup, threshold and union operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.cleaning import strip_leading_zeros
from flowlens.operators.sizing import SMALL_ROWS, pin_if_small

Keys = Sequence[str]


def bank_names(accounts: DataFrame, by: Keys = ()) -> DataFrame:
    """One name per bank id, ids without their leading zeros."""
    return accounts.groupBy(*by, strip_leading_zeros(F.col("bank_id")).alias("bank_key")).agg(
        F.max("bank_name").alias("bank_name")
    )


def with_bank_name(
    df: DataFrame,
    accounts: DataFrame,
    by: Keys = (),
    unknown: str = "Unknown",
    small_rows: int | None = SMALL_ROWS,
) -> DataFrame:
    """Adds `bank_name` by the origin bank; ids match with or without leading zeros.

    For many rows per bank, keep `small_rows`: names that prove few are broadcast. When
    `df` holds one row per bank already, pass None and let Spark choose.
    """
    names = bank_names(accounts, by)
    if small_rows is not None:
        names = pin_if_small(names, small_rows)
    keyed = df.withColumn("bank_key", strip_leading_zeros(F.col("from_bank")))
    joined = keyed.join(names, [*by, "bank_key"], "left").drop("bank_key")
    return joined.withColumn("bank_name", F.coalesce("bank_name", F.lit(unknown)))


def below_average(
    candidates: DataFrame,
    averages: DataFrame,
    divisor: float = 100,
    key: str = "payment_format",
    amount: str = "amount_paid",
    by: Keys = (),
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Candidates under ``average / divisor`` of their own group. A group without an
    average has nothing to compare with and is dropped; a missing amount is zero."""
    averages = pin_if_small(averages.select(*by, key, "average_amount"), small_rows)
    joined = candidates.join(averages, [*by, key])
    below = F.coalesce(F.col(amount), F.lit(0.0)) < F.col("average_amount") / F.lit(float(divisor))
    return joined.where(below).drop("average_amount")


def union_streams(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs, columns matched by name and filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def purge_clients(df: DataFrame, cancelled: DataFrame, client: str = "client_id") -> DataFrame:
    """Drops everything held for cancelled clients. Few of them are broadcast, which keeps
    the rows of a large client from meeting in one task."""
    gone = pin_if_small(cancelled.select(client).distinct())
    return df.join(gone, client, "left_anti")
