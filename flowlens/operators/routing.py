"""Sending rows to one or more destinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.cleaning import shard_number
from flowlens.functions.predicates import all_of

Routes = Mapping[str, Sequence[Mapping[str, Any]]]


def route(df: DataFrame, routes: Routes, column: str = "route") -> DataFrame:
    """One output row per route whose filters all pass, so overlapping routes repeat a
    row. The names travel in `column`, ready for ``partitionBy(column)`` on write."""
    matches = F.array(*(F.when(all_of(specs), F.lit(name)) for name, specs in routes.items()))
    return df.select("*", F.explode(F.array_compact(matches)).alias(column))


def split(df: DataFrame, routes: Routes) -> dict[str, DataFrame]:
    """The same as one DataFrame per route; each filter reaches the scan by itself."""
    return {name: df.where(all_of(specs)) for name, specs in routes.items()}


def endpoints(df: DataFrame) -> DataFrame:
    """Each row under both of its accounts as (bank, account), once if they coincide."""
    ends = F.array_distinct(
        F.array(
            F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")),
            F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")),
        )
    )
    return df.select("*", F.explode(ends).alias("_end")).select(
        "_end.bank", "_end.account", *df.columns
    )


def with_shard(df: DataFrame, key: Sequence[str], shards: int, column: str = "shard") -> DataFrame:
    """Adds the shard 1..n of the key, for exports that must land in fixed files.
    Ordinary queries need none of this: Spark hashes shuffle keys itself."""
    text = F.concat_ws("_", *(F.coalesce(F.col(k), F.lit("None")) for k in key))
    return df.withColumn(column, shard_number(text, shards))
