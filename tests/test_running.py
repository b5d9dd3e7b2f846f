"""Running totals: readable after every micro-batch, late rows noticed."""

import datetime

import pytest
from pyspark.sql import functions as F

from flowlens.session import run_folder
from flowlens.streaming.ingest import stream_parquet
from flowlens.streaming.running import keep_totals, standing

SCHEMA = "at timestamp_ntz, client string, amount double"


def day(n, hour=0):
    return datetime.datetime(2024, 1, n, hour)


@pytest.fixture
def step(spark, tmp_path):
    source, folder = str(tmp_path / "in"), run_folder(spark, "running")

    def run(*rows, delay="2 days"):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stream_parquet(spark, source, SCHEMA)
        totals = {"count": F.count("*"), "total": F.sum("amount")}
        schema = keep_totals(stream, folder, totals, "at", "1 day", delay, by=["client"])
        found = {(r["since"].day, r["client"]): (r["count"], r["total"]) for r in standing(spark, folder, schema, ["client"]).collect()}
        return found, (folder, schema)

    return run


def test_totals_stand_after_every_batch(spark, step):
    first, (folder, schema) = step((day(1), "a", 1.0), (day(1, 5), "a", None), (day(2), None, 2.0))
    assert first == {(1, "a"): (2, 1.0), (2, None): (1, 2.0)}
    second, _ = step((day(1, 23), "a", 4.0), (day(3), "b", 8.0))
    assert second == {(1, "a"): (3, 5.0), (2, None): (1, 2.0), (3, "b"): (1, 8.0)}
    third, _ = step((day(9), "a", 1.0))  # lets go of all spans before
    assert third == {**second, (9, "a"): (1, 1.0)}
    before = standing(spark, folder, schema, ["client"], at=0)
    assert {(r["since"].day, r["client"]): (r["count"], r["total"]) for r in before.collect()} == first


def test_late_rows_are_an_error(step):
    step((day(1), "a", 1.0), (day(9), "a", 1.0))
    with pytest.raises(Exception, match="longer delay"):
        step((day(1), "a", 1.0))


def test_rows_without_time_are_an_error(step):
    with pytest.raises(Exception, match="a row without at"):
        step((day(1), "a", 1.0), (None, "a", 1.0))


def test_empty_table(step):
    assert step()[0] == {}
