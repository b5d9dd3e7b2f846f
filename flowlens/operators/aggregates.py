"""Aggregations. All have a map-side partial form, so a hot key reaches the shuffle as
at most one row per input partition. `by` are leading keys that keep clients apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.operators.routing import endpoints
from flowlens.schema import FROM, TO

Keys = Sequence[str]


def _amount(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def largest_per_group(
    df: DataFrame,
    key: str = "from_bank",
    label: str = "from_account",
    amount: str = "amount_paid",
    by: Keys = (),
) -> DataFrame:
    """The largest amount of each group and the account that paid it. A missing amount
    counts as zero; of equal amounts the smallest label wins.

    The input is first reduced to one row per label by a hash aggregation. Only what is left of
    it meets the comparison of pairs, which aggregates by sorting."""
    per_label = df.groupBy(*by, key, label).agg(F.max(_amount(amount)).alias("most"))
    best = F.min(F.struct((-F.col("most")).alias("negated"), F.col(label).alias("label")))
    return (
        per_label.groupBy(*by, key)
        .agg(best.alias("best"))
        .select(*by, key, F.col("best.label").alias(label), (-F.col("best.negated")).alias(amount))
    )


def average_parts(
    df: DataFrame, key: str = "payment_format", amount: str = "amount_paid", by: Keys = ()
) -> DataFrame:
    """Sum and row count per group, the mergeable form of the average."""
    return df.groupBy(*by, key).agg(
        F.sum(_amount(amount)).alias("total_amount"), F.count("*").alias("tx_quantity")
    )


def merge_average_parts(parts: DataFrame, key: str = "payment_format", by: Keys = ()) -> DataFrame:
    """Averages from partial sums; no rows at all average to zero."""
    total = F.sum(F.coalesce("total_amount", F.lit(0.0)))
    rows = F.sum(F.coalesce("tx_quantity", F.lit(0)))
    return parts.groupBy(*by, key).agg(
        F.when(rows > 0, total / rows).otherwise(0.0).alias("average_amount")
    )


def average_per_group(
    df: DataFrame, key: str = "payment_format", amount: str = "amount_paid", by: Keys = ()
) -> DataFrame:
    """Average where a missing amount is a zero that still counts as a row. A NULL key
    is a group of its own."""
    return df.groupBy(*by, key).agg(
        (F.sum(_amount(amount)) / F.count("*")).alias("average_amount")
    )


def count_pairs(df: DataFrame, min_count: int = 5, by: Keys = ()) -> DataFrame:
    """Rows per (origin, destination) pair, pairs under `min_count` left out."""
    counted = df.groupBy(*by, *FROM, *TO).agg(F.count("*").alias("count"))
    return counted.where(F.col("count") >= min_count)


def merge_pair_counts(df: DataFrame, min_count: int = 5, by: Keys = ()) -> DataFrame:
    """The same over rows that may carry a count already; one without counts once."""
    amount = F.coalesce(F.col("count"), F.lit(1)) if "count" in df.columns else F.lit(1)
    merged = df.groupBy(*by, *FROM, *TO).agg(F.sum(amount).alias("count"))
    return merged.where(F.col("count") >= min_count)


def row_count(df: DataFrame, by: Keys = (), groups: DataFrame | None = None) -> DataFrame:
    """Number of rows, zero for empty input. With `by`, `groups` lists the keys that must
    appear even when nothing was counted for them."""
    if not by:
        return df.agg(F.count("*").alias("count"))
    counts = df.groupBy(*by).agg(F.count("*").alias("count"))
    if groups is None:
        return counts
    return (
        groups.select(*by)
        .distinct()
        .join(counts, list(by), "left")
        .select(*by, F.coalesce("count", F.lit(0)).alias("count"))
    )


def distinct_accounts(df: DataFrame, by: Keys = ()) -> DataFrame:
    """Every (bank, account) at either end of a row, once."""
    return endpoints(df.select(*by, *FROM, *TO)).select(*by, "bank", "account").distinct()
