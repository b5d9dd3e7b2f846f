"""The five questions on hand-made rows, and on example files with known answers: those of
tests/examples, or of the folder that FLOWLENS_EXAMPLES names."""

import os
from pathlib import Path

import pytest

from flowlens.operators.validate import same_multiset
from flowlens.plans import questions
from flowlens.schema import ACCOUNTS, RATES, RESULTS
from flowlens.sources.csv_tables import read_accounts, read_transactions
from flowlens.sources.results import read_result

EXAMPLES = os.environ.get("FLOWLENS_EXAMPLES", str(Path(__file__).parent / "examples"))


def usd(**row):
    return {"payment_currency": "US Dollar", **row}


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_q1_threshold_is_exclusive_and_on_the_amount_received(tx):
    df = tx(
        usd(from_bank="1", amount_received=50.0, amount_paid=1.0),
        usd(from_bank="2", amount_received=49.99, amount_paid=900.0),
        usd(from_bank="3", amount_received=None, amount_paid=1.0),
    )
    assert values(questions.small_payments(df)) == [("2", None, None, None, 900.0)]


def test_q2_ties_names_and_missing_amounts(spark, tx):
    df = tx(
        usd(from_bank="007", from_account="z", amount_paid=5.0),
        usd(from_bank="007", from_account="a", amount_paid=5.0),
        usd(from_bank="9", from_account="q", amount_paid=None),
    )
    accounts = spark.createDataFrame([("Seven", "07", None, None, None)], ACCOUNTS)
    assert values(questions.bank_maxima(df, accounts)) == [
        ("007", "a", "Seven", 5.0),
        ("9", "q", "Unknown", 0.0),
    ]


def test_q3_windows_and_formats_without_history(tx):
    def row(ts, fmt, paid):
        return usd(ts=ts, from_bank="1", payment_format=fmt, amount_paid=paid)

    df = tx(
        row("2022-09-01T00:00", "Wire", 300.0),
        row("2022-09-05T23:59", "Wire", None),
        row("2022-09-06T00:00", "Wire", 1.49),
        row("2022-09-15T23:59", "Wire", None),
        row("2022-09-15T12:00", "Wire", 1.5),
        row("2022-09-16T00:00", "Wire", 0.1),
        row("2022-09-07T00:00", "ACH", 0.1),
        row(None, "Wire", 0.1),
    )
    got = [tuple(r)[2:] for r in questions.far_below_average(df).collect()]
    assert sorted(got, key=str) == [("Wire", 1.49), ("Wire", None)]


def test_q5_conversion_rules(spark, tx):
    def row(currency, paid, ts="2022-09-02T10:00", fmt="Wire"):
        return {"ts": ts, "payment_currency": currency, "amount_paid": paid, "payment_format": fmt}

    import datetime

    rates = spark.createDataFrame([(datetime.date(2022, 9, 2), "EUR", 0.5)], RATES)
    df = tx(
        row("US Dollar", 0.99),
        row("US Dollar", 1.0),
        row("Euro", 0.49),
        row("Euro", 0.5),
        row("Euro", 0.1, ts="2022-09-03T10:00"),
        row("Bitcoin", 0.1),
        row("Doubloon", 0.1),
        row("Euro", None),
        row(None, 0.1),
        row("US Dollar", 0.1, ts=None),
        row("US Dollar", 0.1, fmt="Cheque"),
        row("Euro", 0.1, ts="2022-09-01T10:00", fmt="ACH"),
    )
    assert questions.micro_payment_count(df, rates).first()["count"] == 2
    p = questions.Parameters(as_of_rates=True)
    assert questions.micro_payment_count(df, rates, p).first()["count"] == 3


def test_q5_counts_nothing_as_zero_and_per_client(spark, tx):
    rates = spark.createDataFrame([], RATES)
    assert questions.micro_payment_count(tx(), rates).collect()[0]["count"] == 0
    clients = spark.createDataFrame([("a",), ("b",)], "client_id string")
    from pyspark.sql import functions as F

    df = tx(usd(ts="2022-09-02T10:00", payment_format="ACH", amount_paid=0.2)).withColumn("client_id", F.lit("a"))
    got = questions.micro_payment_count(df, rates, by=["client_id"], groups=clients)
    assert values(got) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_example_answers(spark, partitions):
    import datetime

    transactions = read_transactions(spark, f"{EXAMPLES}/transactions.csv").repartition(partitions)
    accounts = read_accounts(spark, f"{EXAMPLES}/accounts.csv")
    days = [(datetime.date(2022, 9, d), "EUR", 1.0) for d in range(1, 31)]
    answers = questions.answer_all(transactions, accounts, spark.createDataFrame(days, RATES))
    for query in ("q1", "q2", "q3", "q5"):
        expected = read_result(spark, f"{EXAMPLES}/{query}.csv", query)
        assert answers[query].columns == RESULTS[query].names
        assert same_multiset(answers[query], expected), query
    assert answers["q4"].count() == 0


def test_example_scatter_gather(spark):
    transactions = read_transactions(spark, f"{EXAMPLES}/scatter.csv")
    ends = questions.scatter_gather(questions.in_currency(transactions))
    assert values(ends) == [("N1", "start"), ("N9", "finish")]
