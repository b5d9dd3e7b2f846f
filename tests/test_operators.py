"""Edge cases of the single operators."""

import datetime
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.functions import predicates as P
from flowlens.functions.cleaning import blank_to_null, parse_timestamp, strip_leading_zeros
from flowlens.operators import aggregates, joins, projection, routing, validate
from flowlens.operators.sizing import pin_if_small
from flowlens.schema import RESULTS


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2022/09/01 00:17", "2022-09-01 00:17:00"),
        ("2022/9/1 0:17", "2022-09-01 00:17:00"),
        ("2022/09/01 00:17:42", "2022-09-01 00:17:42"),
        (" 2022/09/01 00:17\r", "2022-09-01 00:17:00"),
        ("2022-09-01 00:17", None),
        ("2022/13/01 00:17", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).alias("ts")).first()
    assert (str(row["ts"]) if row["ts"] else None) == want


def test_text_cleaning(spark):
    df = spark.createDataFrame([("  x y\t\r\n",), ("  ",), ("000",), ("0120",)], "t string")
    got = [r[0] for r in df.select(blank_to_null(F.col("t"))).collect()]
    assert got == ["x y", None, "000", "0120"]
    assert [r[0] for r in df.select(strip_leading_zeros(F.col("t"))).collect()][2:] == ["", "120"]


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        P.amount_compares("<=", 1)
    with pytest.raises(ValueError):
        P.predicate({"type": "regex"})


@pytest.mark.parametrize("spec", [
    {"type": "date_range", "from": "2022-09-05T12:00", "to": "2022-09-06"},
    {"type": "date_range", "from": datetime.datetime(2022, 9, 5), "to": "2022-09-06"},
    {"type": "date_range", "from": "2022-09-07", "to": "2022-09-06"},
    {"type": "date_range", "from": "2022-09-05"},
    {"type": "currency", "value": "Euro", "values": ["Yen"]},
    {"type": "payment_format_in", "values": "Wire"},
])
def test_wrong_fields_of_a_filter_are_errors(spec):
    with pytest.raises(ValueError):
        P.predicate(spec)


def test_empty_conjunction_matches_all(tx):
    df = tx({"from_bank": "1"}, {})
    assert df.where(P.all_of([])).count() == 2


def test_missing_dates_match_no_range(tx):
    df = tx({"ts": None}, {"ts": "2022-09-01T00:00"}, {"ts": "2022-09-05T23:59:59"}, {"ts": "2022-09-06T00:00"})
    assert df.where(P.date_between("2022-09-01", "2022-09-05")).count() == 2


def test_date_range_reaches_the_scan(spark, tx, tmp_path):
    tx({"ts": "2022-09-01T00:00"}).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(P.date_between("2022-09-01", "2022-09-05"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2022-09-01" in plan and "LessThan(ts,2022-09-06" in plan


def test_average_counts_missing_amounts(tx):
    df = tx(
        {"payment_format": "Wire", "amount_paid": 10.0},
        {"payment_format": "Wire", "amount_paid": None},
        {"payment_format": None, "amount_paid": 4.0},
    )
    want = [("Wire", 5.0), (None, 4.0)]
    assert values(aggregates.average_per_group(df)) == sorted(want, key=str)
    assert values(aggregates.merge_average_parts(aggregates.average_parts(df))) == sorted(want, key=str)


def test_a_null_format_never_matches_its_average(tx):
    df = tx({"payment_format": None, "amount_paid": 400.0})
    averages = aggregates.average_per_group(df)
    assert joins.below_average(tx({"payment_format": None, "amount_paid": 0.0}), averages).count() == 0


def test_pair_counts_merge(spark):
    rows = [("a", "1", "b", "2", 3), ("a", "1", "b", "2", None), ("a", "1", "b", "2", 1), ("x", "1", "b", "2", 4)]
    df = spark.createDataFrame(
        rows, "from_bank string, from_account string, to_bank string, to_account string, count bigint"
    )
    assert values(aggregates.merge_pair_counts(df)) == [("a", "1", "b", "2", 5)]
    assert df.where(P.count_compares("=", 0)).count() == 1
    assert df.select(F.lit(None).cast("int").alias("count")).where(P.count_compares("=", 0)).count() == 4


def test_endpoints_once_for_a_self_payment(tx):
    df = tx(
        {"from_bank": "1", "from_account": "a", "to_bank": "1", "to_account": "a"},
        {"from_bank": "1", "from_account": "a", "to_bank": "2", "to_account": "a"},
    )
    assert routing.endpoints(df).count() == 3
    assert values(aggregates.distinct_accounts(df)) == [("1", "a"), ("2", "a")]


def test_routes_overlap_and_split_agrees(tx):
    df = tx({"ts": "2022-09-03T00:00"}, {"ts": "2022-09-06T00:00"}, {"ts": "2022-10-01T00:00"})

    def window(first, last):
        return [{"type": "date_range", "from": first, "to": last}]

    routes = {"history": window("2022-09-01", "2022-09-05"), "scatter": window("2022-09-01", "2022-09-06")}
    counts = {r["route"]: r["count"] for r in routing.route(df, routes).groupBy("route").count().collect()}
    assert counts == {"history": 1, "scatter": 2}
    assert {name: part.count() for name, part in routing.split(df, routes).items()} == counts


def test_shards_are_the_published_checksum(spark):
    df = spark.createDataFrame([("011", "8000"), ("x", None)], "bank string, account string")
    got = [r["shard"] for r in routing.with_shard(df, ["bank", "account"], 3).collect()]
    assert got == [zlib.crc32(b"011_8000") % 3 + 1, zlib.crc32(b"x_None") % 3 + 1]


def test_projection_defaults(spark):
    df = spark.createDataFrame([("c", 1)], "client_id string, x int")
    assert projection.project_to(df, RESULTS["q5"], ["client_id"]).first().asDict() == {"client_id": "c", "count": 0}
    assert projection.project_to(df, RESULTS["q4"]).first().asDict() == {"bank": None, "account": None}


@pytest.mark.parametrize("limit, broadcast", [(10, True), (2, False)])
def test_only_small_sides_are_broadcast(spark, limit, broadcast):
    small = spark.range(3).withColumn("name", F.lit("x"))
    side = pin_if_small(small, limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.range(100).join(side, "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcast
        assert joined.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bank_names_either_way(spark, tx):
    from flowlens.schema import ACCOUNTS

    accounts = spark.createDataFrame(
        [("One", "0011", None, None, None), ("Uno", "11", None, None, None), (None, "5", None, None, None)], ACCOUNTS
    )
    df = tx({"from_bank": "011"}, {"from_bank": "5"}, {"from_bank": None}).select("from_bank")
    for rows in (None, 0, 100):
        got = values(joins.with_bank_name(df, accounts, small_rows=rows))
        assert got == sorted([("011", "Uno"), ("5", "Unknown"), (None, "Unknown")], key=str)


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), (None, 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), (None, 2.0), ("y", 3.0)], "k string, v double")
    assert values(validate.diff_multiset(a, b)) == [("x", 1.0, 2, 1), ("y", 3.0, 0, 1)]
    assert validate.same_multiset(a, a.select("k", "v")) and not validate.same_multiset(a, b)


def test_count_expectations(spark):
    results = {"q1": spark.range(3), "q5": spark.createDataFrame([(9,)], "count bigint")}
    got = validate.check_counts(results, {"q1": 4, "q5": 1, "q4": 0, "q2": 1}, {"q5": 9})
    assert {r["query"]: r["status"] for r in got.collect()} == {
        "q1": "FAIL", "q5": "PASS", "q4": "PASS", "q2": "FAIL",
    }
    wrong = validate.check_counts(results, {"q5": 1}, {"q5": 8})
    assert wrong.first()["status"] == "FAIL"


def test_clients_agree(spark):
    clients = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "client_id string")
    rows = [("a", 1), ("a", 1), ("a", None), ("b", 1), ("b", None), ("b", 1), ("c", 1), ("c", None)]
    got = validate.diff_clients(spark.createDataFrame(rows, "client_id string, v int"), clients)
    assert {r["client_id"]: r["agrees"] for r in got.collect()} == {"a": True, "b": True, "c": False, "d": False}
    nobody = validate.diff_clients(spark.createDataFrame([], "client_id string, v int"), clients)
    assert all(r["agrees"] for r in nobody.collect())


def test_purge(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "client_id string, v int")
    gone = spark.createDataFrame([("a",), ("a",)], "client_id string")
    assert values(joins.purge_clients(df, gone)) == [("b", 2), (None, 3)]
