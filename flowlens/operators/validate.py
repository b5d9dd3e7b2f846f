"""Comparing results with each other and with expectations, without sorting them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.session import materialize


def diff_multiset(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with both numbers; empty when equal.
    One shuffle with partial counts, and NULLs compare equal."""
    columns = expected.columns
    tagged = got.select(*columns, F.lit(1).alias("_g"), F.lit(0).alias("_e")).unionByName(
        expected.select(*columns, F.lit(0).alias("_g"), F.lit(1).alias("_e"))
    )
    return (
        tagged.groupBy(*columns)
        .agg(F.sum("_g").alias("got"), F.sum("_e").alias("expected"))
        .where(F.col("got") != F.col("expected"))
    )


def same_multiset(got: DataFrame, expected: DataFrame) -> bool:
    return diff_multiset(got, expected).isEmpty()


def check_counts(
    results: Mapping[str, DataFrame],
    expected_rows: Mapping[str, int],
    expected_values: Mapping[str, Any] | None = None,
) -> DataFrame:
    """One row per query: expected and actual number of rows and PASS or FAIL. A query in
    `expected_values` must also hold that value in its first column. A missing result
    passes only where no rows are expected."""
    values = dict(expected_values or {})
    if not expected_rows:
        raise ValueError("no expectations given")
    spark = next(iter(results.values())).sparkSession
    checks = []
    for query, rows in expected_rows.items():
        if query in results:
            df = results[query]
            wanted = values.get(query)
            if query in values:
                hits = F.count_if(F.col(df.columns[0]) == F.lit(wanted))
            else:
                hits = F.count("*")
            check = df.agg(F.count("*").alias("actual"), hits.alias("hits"))
        else:
            check = spark.range(1).select(F.lit(0).alias("actual"), F.lit(0).alias("hits"))
        ok = (F.col("actual") == rows) & (F.col("hits") == F.col("actual"))
        checks.append(
            check.select(
                F.lit(query).alias("query"),
                F.lit(rows).cast("long").alias("expected"),
                F.col("actual").cast("long").alias("actual"),
                F.when(ok, "PASS").otherwise("FAIL").alias("status"),
            )
        )
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def diff_clients(
    results: DataFrame, clients: DataFrame, client: str = "client_id"
) -> DataFrame:
    """Whether each client got the answer of the first one, as a multiset.

    Counts copies per (row, client), puts the first client's count next to the others', and
    adds up per client: equal means as many different rows as the first client has, all
    with the same number of copies. Groups hold at most one entry per client, and no pair
    of clients is ever compared row by row.
    """
    columns = [c for c in results.columns if c != client]
    first = clients.agg(F.min(client)).first()[0]
    copies = results.groupBy(client, *columns).agg(F.count("*").alias("_n"))
    of_first = F.max(F.when(F.col(client) == F.lit(first), F.col("_n")))
    marked = copies.withColumn("_wanted", of_first.over(Window.partitionBy(*columns)))
    per_client = materialize(
        marked.groupBy(client).agg(
            F.sum("_n").alias("rows"),
            F.count("*").alias("_different"),
            F.count_if(F.col("_n") == F.col("_wanted")).alias("_matching"),
        )
    )
    wanted = per_client.where(F.col(client) == F.lit(first)).select("_different").first()
    agrees = (F.col("_matching") == F.col("_different")) & (
        F.col("_different") == F.lit(wanted[0] if wanted else 0)
    )
    counted = clients.select(client).distinct().join(per_client, client, "left")
    return counted.fillna(0, ["rows", "_different", "_matching"]).select(
        client, "rows", agrees.alias("agrees")
    )
