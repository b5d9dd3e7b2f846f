"""Conversion to the base currency with a table of daily rates
(`rate_date`, `code`, `rate`: units of the currency per unit of the base)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.functions.currency import BASE_CURRENCY, currency_code
from flowlens.operators.sizing import pin_if_small
from flowlens.session import materialize

# Some thirty years of daily rates for every known currency.
RATE_ROWS = 150_000
NO_CODE_KEYS = 1_000


def _one_rate_per_day(rates: DataFrame) -> DataFrame:
    return rates.groupBy("rate_date", "code").agg(F.max("rate").alias("rate"))


def rate_in_force(daily: DataFrame, last_day: datetime.date | None) -> DataFrame:
    """Daily rates, one per day and code, with their gaps filled: each rate stands until the day
    before the next, the last ones until `last_day`. Days times currencies bound its size."""
    following = F.lead("rate_date").over(Window.partitionBy("code").orderBy("rate_date"))
    until = F.coalesce(F.date_sub(following, 1), F.lit(last_day).cast("date"))
    spans = daily.withColumn("_until", until)
    return spans.select(F.explode(F.sequence("rate_date", "_until")).alias("rate_date"), "code", "rate")


def with_base_amount(
    df: DataFrame,
    rates: DataFrame,
    as_of: bool = False,
    amount: str = "amount_paid",
    column: str = "usd",
    rate_rows: int = RATE_ROWS,
) -> DataFrame:
    """Adds `column`, the amount in the base currency, and drops rows that cannot be
    converted: a missing field, Bitcoin or another unknown currency, no rate for the day.

    `as_of` takes the last rate on or before the day instead of the day's own. Both forms
    join on equal day and code. A range condition would compare each row with every rate
    of its currency; filling the gaps first avoids that, and days after the table's last
    one look up that last day.
    """
    day, table = F.to_date("ts"), _one_rate_per_day(rates)
    if as_of:
        table = materialize(table)  # read twice
        last_day = table.agg(F.max("rate_date")).first()[0]
        table, day = rate_in_force(table, last_day), F.least(day, F.lit(last_day).cast("date"))
    table = pin_if_small(table, rate_rows).alias("_r")
    code = currency_code(F.col("payment_currency"))
    # Rows without a rate to look up would all share one key if the join shuffles.
    none = F.concat(F.lit("#"), F.pmod(F.xxhash64("ts", amount), F.lit(NO_CODE_KEYS)).cast("string"))
    match = (F.coalesce(code, none) == F.col("_r.code")) & (day == F.col("_r.rate_date"))
    in_base = F.col("payment_currency") == F.lit(BASE_CURRENCY)
    converted = F.when(in_base, F.col(amount)).otherwise(
        F.try_divide(F.col(amount), F.col("_r.rate"))
    )
    return (
        df.where(in_base | code.isNotNull())
        .join(table, match, "left")
        .withColumn(column, F.when(F.col("ts").isNotNull(), converted))
        .where(F.col(column).isNotNull())
        .select(*df.columns, column)
    )
