"""Operators by name, for use in a stage configuration.

Each entry takes the input, the side inputs, the parameters and the client keys. Names that
occur both as a partial and as a final step accept their own output, so a configuration may
list the two steps or one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.predicates import KINDS, format_in
from flowlens.operators import aggregates, graph, joins
from flowlens.operators.fx import with_base_amount
from flowlens.operators.projection import project_to
from flowlens.operators.routing import endpoints
from flowlens.schema import FROM, RESULTS, TO

Side = Mapping[str, DataFrame]
Params = Mapping[str, Any]
Keys = Sequence[str]
Strategy = Callable[[DataFrame, Side, Params, Keys], DataFrame]


def _amount(df: DataFrame, side: Side, p: Params, by: Keys) -> DataFrame:
    return project_to(df.where(KINDS["amount"].read(p).column()), RESULTS["q1"], by)


def _conversion(df: DataFrame, side: Side, p: Params, by: Keys) -> DataFrame:
    wanted = df.where(format_in(p["conditions"]))
    converted = with_base_amount(wanted, side["rates"], bool(p.get("as_of", False)))
    return converted.where(F.col("usd") < float(p.get("below", 1))).drop("usd")


def _count(df: DataFrame, side: Side, p: Params, by: Keys) -> DataFrame:
    if "threshold" in p:
        return df.where(KINDS["count"].read(p).column())
    return aggregates.row_count(df, by, side.get("groups"))


def _average(df: DataFrame, side: Side, p: Params, by: Keys) -> DataFrame:
    if "average_amount" in df.columns:
        return df
    if "total_amount" in df.columns:
        return aggregates.merge_average_parts(df, by=by)
    return aggregates.average_per_group(df, by=by)


def _accounts_at_ends(df: DataFrame, side: Side, p: Params, by: Keys) -> DataFrame:
    if "bank" in df.columns:
        return df.select(*by, "bank", "account").distinct()
    return aggregates.distinct_accounts(df, by)


# The names are those configurations use and thereby fixed values.
STRATEGIES: dict[str, Strategy] = {
    "none": lambda df, side, p, by: df,
    "currency": lambda df, side, p, by: df.where(KINDS["currency"].read(p).column()),
    "amount": _amount,
    "currency_conversion": _conversion,
    "count": _count,
    "bank_max_amount": lambda df, side, p, by: aggregates.largest_per_group(df, by=by),
    "payment_format_average": _average,
    "account_pair_count": lambda df, side, p, by: aggregates.merge_pair_counts(
        df, int(p.get("min_count", 5)), by
    ),
    "account": _accounts_at_ends,
    "merge_routing": lambda df, side, p, by: endpoints(df),
    "scatter_group": lambda df, side, p, by: df.select(*by, *FROM, *TO),
    "scatter_aggregator": lambda df, side, p, by: graph.scatter_transactions(
        df, int(p.get("min_destinations", 5)), by
    ),
    "accounts": lambda df, side, p, by: joins.with_bank_name(df, side["accounts"], by),
    "self_merge": lambda df, side, p, by: graph.two_hop_pairs(df, by),
    # scatter_aggregator, self_merge, account_pair_count and account in one, without every pair
    "scatter_gather": lambda df, side, p, by: graph.scatter_gather_accounts(
        df, int(p.get("min_destinations", 5)), int(p.get("min_paths", 5)), by
    ),
    "historical_average": lambda df, side, p, by: joins.below_average(
        df, side["averages"], float(p.get("threshold_divisor", 100)), by=by
    ),
    "averages_union": lambda df, side, p, by: joins.union_streams(df, *side.values()),
    "query_result": lambda df, side, p, by: project_to(df, RESULTS[f"q{p['query']}"], by),
}


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}, expected one of {sorted(STRATEGIES)}")
    return STRATEGIES[name]
