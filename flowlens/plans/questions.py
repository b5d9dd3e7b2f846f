"""The five questions. Every constant is a parameter; `by` names leading key columns that
answer the question once per client."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.currency import BASE_CURRENCY
from flowlens.functions.predicates import amount_compares, currency_is, date_between, format_in
from flowlens.operators.aggregates import average_per_group, largest_per_group, row_count
from flowlens.operators.fx import with_base_amount
from flowlens.operators.graph import scatter_gather_accounts
from flowlens.operators.joins import below_average, union_streams, with_bank_name
from flowlens.operators.projection import project_to
from flowlens.schema import RESULTS, TRANSACTIONS
from flowlens.session import materialize

Keys = Sequence[str]
Window = tuple[Any, Any]


@dataclass(frozen=True)
class Parameters:
    currency: str = BASE_CURRENCY
    small_amount: float = 50
    history: Window = ("2022-09-01", "2022-09-05")
    candidates: Window = ("2022-09-06", "2022-09-15")
    divisor: float = 100
    scatter: Window = ("2022-09-01", "2022-09-06")
    min_destinations: int = 5
    min_paths: int = 5
    micro: Window = ("2022-09-01", "2022-09-05")
    micro_formats: Sequence[str] = field(default=("Wire", "ACH"))
    micro_amount: float = 1
    as_of_rates: bool = False


DEFAULTS = Parameters()


def in_currency(transactions: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    return transactions.where(currency_is(p.currency))


def small_payments(usd: DataFrame, p: Parameters = DEFAULTS, by: Keys = ()) -> DataFrame:
    """Q1: payments in the currency with a small amount received."""
    return project_to(usd.where(amount_compares("<", p.small_amount)), RESULTS["q1"], by)


def bank_maxima(usd: DataFrame, accounts: DataFrame, by: Keys = ()) -> DataFrame:
    """Q2: the largest payment of each origin bank with the bank's name."""
    largest = largest_per_group(usd, by=by)
    return project_to(with_bank_name(largest, accounts, by, small_rows=None), RESULTS["q2"], by)


def far_below_average(usd: DataFrame, p: Parameters = DEFAULTS, by: Keys = ()) -> DataFrame:
    """Q3: payments far below the earlier average of their payment format."""
    averages = average_per_group(usd.where(date_between(*p.history)), by=by)
    candidates = project_to(usd.where(date_between(*p.candidates)), RESULTS["q3"], by)
    return project_to(below_average(candidates, averages, p.divisor, by=by), RESULTS["q3"], by)


def scatter_gather(usd: DataFrame, p: Parameters = DEFAULTS, by: Keys = ()) -> DataFrame:
    """Q4: accounts at either end of a scatter-gather pattern."""
    in_window = usd.where(date_between(*p.scatter))
    ends = scatter_gather_accounts(in_window, p.min_destinations, p.min_paths, by)
    return project_to(ends, RESULTS["q4"], by)


def micro_payments(
    transactions: DataFrame, rates: DataFrame, p: Parameters = DEFAULTS, by: Keys = ()
) -> DataFrame:
    """The rows Q5 counts: given formats, any currency, worth less than a small amount."""
    wanted = transactions.where(date_between(*p.micro) & format_in(p.micro_formats))
    return with_base_amount(wanted, rates, p.as_of_rates).where(F.col("usd") < p.micro_amount)


def micro_payment_count(
    transactions: DataFrame,
    rates: DataFrame,
    p: Parameters = DEFAULTS,
    by: Keys = (),
    groups: DataFrame | None = None,
) -> DataFrame:
    """Q5: how many there are, zero included."""
    return row_count(micro_payments(transactions, rates, p, by), by, groups)


def answer_all(
    transactions: DataFrame,
    accounts: DataFrame,
    rates: DataFrame,
    p: Parameters = DEFAULTS,
    by: Keys = (),
    groups: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All five from one pass over the transactions: the rows that any question asks for, with the
    columns they ask for, are written to the shared folder once, and every branch reads its part
    from there. With `by`, `groups` lists the clients that get a count even of nothing."""
    in_base, micro = currency_is(p.currency), date_between(*p.micro) & format_in(p.micro_formats)
    read = [*by, *(c for c in TRANSACTIONS.names if c != "receiving_currency" and c in transactions.columns)]
    wanted = materialize(transactions.where(in_base | micro).select(*dict.fromkeys(read)))
    usd = in_currency(wanted, p)
    return {
        "q1": small_payments(usd, p, by),
        "q2": bank_maxima(usd, accounts, by),
        "q3": far_below_average(usd, p, by),
        "q4": scatter_gather(usd, p, by),
        "q5": micro_payment_count(wanted, rates, p, by, groups),
    }


def as_one_table(results: dict[str, DataFrame], by: Keys = ()) -> DataFrame:
    """The answers below each other, with the query's name and NULL in foreign columns."""
    return union_streams(
        *(df.select(F.lit(name).alias("query"), *by, *RESULTS[name].names) for name, df in results.items())
    )
