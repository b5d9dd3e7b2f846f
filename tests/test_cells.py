"""Paths counted in the cells of a grid."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.catalog import streams
from flowlens.catalog.queries import QUERIES
from flowlens.operators import cells, graph
from flowlens.session import settings

SCHEMA = "client_id string, from_bank string, from_account string, to_bank string, to_account string"


class Always(cells.Grid):
    def moved(self, firsts, lasts):
        return -1.0


def payments():
    nodes = [("b", str(i)) for i in range(12)] + [("c", "1"), ("b", None), (None, "2")]
    rows = [(f"u{i % 3}" if i % 50 else None, *nodes[i * i * 7 % 15], *nodes[(i * 11 + i // 15) % 15]) for i in range(900)]
    return rows + rows[:200]


def plain(rows):
    """Pairs of payments that meet, compared as SQL compares."""
    found = Counter()
    for u, *a, b1, b2 in rows:
        for v, c1, c2, *d in rows:
            if None not in (u, v, b1, b2, c1, c2) and (u, b1, b2) == (v, c1, c2):
                parts = [None if None in pair else pair[0] == pair[1] for pair in zip(a, d)]
                if False in parts:
                    found[(u, *a, *d)] += 1
    return dict(found)


@pytest.mark.parametrize("grid", [(1, 1), (3, 2), (7, 5)])
def test_cells_equal_brute_force(spark, monkeypatch, grid):
    rows = payments()
    monkeypatch.setattr(graph, "grid_for", lambda *_: Always(*grid))
    got = graph.two_hop_pairs(spark.createDataFrame(rows, SCHEMA), ["client_id"]).collect()
    assert {tuple(r)[:-1]: r["count"] for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_many_paths_are_not_shuffled(spark, tmp_path):
    """800 payers, 40 middles, 40 ends: 1.3 million paths over 33,600 edges, which were all shuffled to
    their pairs before."""
    spark.range(800 * 40).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 40).alias("l_suppkey"), F.lit("R").alias("l_returnflag"), F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(800 * 40).select(F.col("id").alias("o_orderkey"), F.floor(F.col("id") / 40).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    found = QUERIES["join_two_hop"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    # everyone pays the middles 0 to 39, and these pay all the others
    assert found.agg(F.count("*"), F.min("count"), F.max("count")).first()[:] == (800 * 40 - 40, 40, 40)


def test_repeated_first_steps_are_lists(spark, monkeypatch):
    """900 steps of 9 starts over three columns. Before, each was a row of its own in every column."""
    tables = []
    monkeypatch.setattr(cells, "materialize", lambda df, made=cells.materialize: tables.append(made(df)) or tables[-1])
    first = spark.range(900).select((F.col("id") % 9).alias("s"), F.col("id").alias("m"), F.lit(2).alias("lw"))
    last = spark.createDataFrame([(7, list(range(0, 900, 2)), [1] * 450), (8, [1, 10], [3, 5])], "e int, _middles array<long>, _weights array<long>")
    got = cells.counted_in_cells(first, last, ["s"], ["e"], "m", ("lw", "rw"), cells.Grid(2, 3), "n")
    want = {(s, 7): 100 for s in range(9)} | {(1, 8): 16}
    assert {(r["s"], r["e"]): r["n"] for r in got.collect()} == want
    assert [t.agg(F.sum(F.size("_middles")), F.count("*")).first()[:] for t in tables] == [(900, 9)]


def test_a_start_across_batches(monkeypatch):
    monkeypatch.setattr(cells, "PATHS_AT_ONCE", 5)
    monkeypatch.setattr(cells, "OUT_ROWS", 3)
    lists, none = [([1, 2, 3], [1, 1, 2]), ([2, 3], [1, 5])], (None, None)
    rows = [(0, f"e{i}", None, None, *pair) for i, pair in enumerate(lists)]
    rows += [(0, s, m, w, *none) for s, m, w in [("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("a", 9, 1), ("b", 9, 1), ("c", 3, 4)]]
    rows += [(1, "x", 1, 1, *none), (2, "e0", None, None, [1], [7]), (2, "a", 1, 1, *none), (2, None, 1, 2, *none)]
    kinds = pa.schema([("_cell", pa.int32()), ("n", pa.string()), ("_m", pa.int64()), ("_w", pa.int64()), ("_middles", pa.list_(pa.int64())), ("_weights", pa.list_(pa.int64()))])
    whole = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)
    want = [("a", "e0", 5), ("a", "e1", 7), ("c", "e0", 8), ("c", "e1", 20), ("a", "e0", 7), (None, "e0", 14)]
    for size in (1, 2, 3, 100):
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in cells._counter(["n"], 1, [0], ["s", "e", "t"])(iter(batches)) for r in b.to_pylist()]
        assert got == want, size


def test_grid_bounds_the_hottest_middle():
    grid = cells.grid_for(1e9, 5e4, 35e6, 2.3e6, 500, 24)
    assert grid.rows * grid.columns >= 100 and grid.moved(35e6, 2.3e6) < 1e9
    assert cells.grid_for(5.0, 5.0, 3.0, 3.0, 4_000_000, 8).moved(3.0, 3.0) > 5.0


@pytest.mark.parametrize("files, written", [(3, 8), (18, 16)])
def test_lines_are_streamed_as_they_lie(spark, tmp_path, monkeypatch, files, written):
    """Before, all columns of the line items were shuffled and written once more, into eight files."""
    spark.range(90).select(*(F.col("id").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))).repartition(files).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(streams, "run_folder", lambda *_: f"{tmp_path}/in")
    conf = {"spark.sql.files.openCostInBytes": "128m", "spark.sql.files.maxPartitionBytes": "1m"}
    with settings(spark, conf):  # a partition per file
        streams._transactions(spark, str(tmp_path))
    lines = spark.read.parquet(f"{tmp_path}/in")
    assert lines.columns == list(streams.LINES) and lines.count() == 90
    assert len(lines.inputFiles()) == written
