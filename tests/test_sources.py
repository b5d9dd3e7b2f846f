"""CSV tables, envelopes and result directories."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from flowlens.schema import RESULTS, TRANSACTIONS
from flowlens.sources import csv_tables, envelopes, rates, results
from flowlens.streaming import ingest

HEADER = (
    "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,"
    "Amount Paid,Payment Currency,Payment Format,Is Laundering"
)


def write(path, *lines, newline="\n"):
    path.write_bytes((newline.join(lines) + newline).encode("utf-8"))
    return str(path)


def test_repeated_header_names():
    assert csv_tables.dedupe_header([" Account", "To", "Account ", "Account"]) == [
        "Account", "To", "Account.1", "Account.2",
    ]


def test_transactions_with_repeated_header(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        HEADER,
        '2022/09/01 00:17,011,8000,"01, 2",8006,50.00,US Dollar,49.5,US Dollar,ACH,0',
        "bad,, x ,2,y,abc,Euro,,Euro,Wire,1",
        "2022/9/2 1:02:03,3",
        newline="\r\n",
    )
    df = csv_tables.read_transactions(spark, path)
    assert df.schema == TRANSACTIONS
    first, bad, short = df.collect()
    assert (first["from_bank"], first["from_account"], first["to_bank"], first["to_account"]) == (
        "011", "8000", "01, 2", "8006",
    )
    assert (first["amount_received"], first["amount_paid"], first["payment_format"]) == (50.0, 49.5, "ACH")
    assert bad["ts"] is None and bad["from_bank"] is None and bad["amount_received"] is None
    assert bad["from_account"] == "x"
    assert str(short["ts"]) == "2022-09-02 01:02:03" and short["payment_format"] is None


def test_columns_by_name_and_absent_ones(spark, tmp_path):
    one = write(tmp_path / "a.csv", "Amount Paid,From Bank", "1.5,7")
    two = write(tmp_path / "b.csv", "From Bank,Amount Paid", "8,2.5")
    rows = csv_tables.read_transactions(spark, one, two).select("from_bank", "amount_paid", "to_bank").collect()
    assert sorted(map(tuple, rows)) == [("7", 1.5, None), ("8", 2.5, None)]


def test_layouts_in_one_folder(spark, tmp_path):
    """Every file is read by its own header; a stream, which has one schema, refuses them."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "Amount Paid,From Bank", "1.5,7", "1.25,7")
    write(folder / "b.csv", "From Bank,Amount Paid", "8,2.5")
    write(folder / "c.csv", "Account,Account,From Bank", "x,y,9")
    (folder / "d.csv").write_bytes(b"")
    columns = ("from_bank", "amount_paid", "from_account", "to_account")
    rows = csv_tables.read_transactions(spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, rows)) == [("7", 1.25, None, None), ("7", 1.5, None, None), ("8", 2.5, None, None), ("9", None, "x", "y")]
    with pytest.raises(ValueError, match="3 layouts"):
        ingest.stream_transactions(spark, str(folder))


def test_writing_a_client_leaves_the_others(spark, tmp_path):
    folder = str(tmp_path / "out")

    def write_for(client, *amounts):
        rows = spark.createDataFrame([(client, "b", "a", "c", "d", x) for x in amounts],
            "client_id string, from_bank string, from_account string, to_bank string, to_account string, amount_paid double")
        results.write_results({"q1": rows}, folder, "client_id")

    write_for("x", 1.0, 2.0)
    write_for("y", 3.0)
    write_for("x", 4.0)
    rows = results.read_result(spark, f"{folder}/q1", "q1", "client_id").select("client_id", "amount_paid").collect()
    assert sorted(map(tuple, rows)) == [("x", 4.0), ("y", 3.0)]


def test_empty_files(spark, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_bytes(b"")
    assert csv_tables.read_transactions(spark, str(empty)).count() == 0
    only_header = write(tmp_path / "h.csv", "Bank Name,Bank ID")
    assert csv_tables.read_accounts(spark, only_header).count() == 0


ROW = T.StructType([T.StructField("from_bank", T.StringType()), T.StructField("amount_paid", T.DoubleType())])


def test_envelopes(spark):
    def message(size, rows, kind="raw_transactions"):
        return {"type": kind, "client": "c", "sender": "s", "msg_id": 1, "payload": {"batch_size": size, "batch": rows}}

    row = {"from_bank": "1", "amount_paid": 2.0}
    texts = [
        json.dumps(message(2, [row, row])),
        json.dumps(message(0, [])),
        json.dumps(message(2, [row])),
        json.dumps(message(1, [row], kind="raw_accounts")),
        json.dumps({"type": "raw_transactions", "client": "c"}),
        json.dumps({"type": "eof", "client": "c", "msg_id": 2}),
        json.dumps({"type": "something_else", "client": "c"}),
        json.dumps({"type": " ", "client": "c"}),
        "not json",
    ]
    messages = envelopes.parse_envelopes(spark.createDataFrame([(t,) for t in texts], "value string"), ROW)
    valid = {r["value"]: r["valid"] for r in messages.collect()}
    assert [valid[t] for t in texts] == [True, True, False, True, False, True, True, False, False]
    rows = envelopes.envelope_rows(messages, "raw_transactions")
    assert rows.columns == ["client", "sender", "msg_id", "from_bank", "amount_paid"] and rows.count() == 2
    assert {r["value"] for r in envelopes.quarantined(messages).collect()} == {t for t in texts if not valid[t]}


def test_results_are_replaced_and_chunked(spark, tmp_path):
    folder = str(tmp_path / "out")
    q5 = spark.createDataFrame([(7,)], "count bigint")
    many = spark.range(25).select(F.lit("b").alias("bank"), F.col("id").cast("string").alias("account"))
    results.write_results({"q5": q5, "q4": many}, folder)
    results.write_results({"q5": q5, "q4": many.coalesce(1)}, folder, max_records_per_file=10)
    assert results.read_result(spark, f"{folder}/q5", "q5").collect()[0]["count"] == 7
    assert results.read_result(spark, f"{folder}/q4", "q4").count() == 25
    assert len(list((tmp_path / "out" / "q4").glob("*.csv"))) == 3


def test_results_per_client(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("x", 1), ("y", 2)], "client_id string, count bigint")
    results.write_results({"q5": df}, folder, client="client_id")
    assert results.read_result(spark, f"{folder}/q5/client_id=y", "q5").collect()[0]["count"] == 2
    assert RESULTS["q5"].names == ["count"]


def test_rate_documents(spark, tmp_path):
    path = write(
        tmp_path / "rates.json",
        '{"amount": 1.0, "base": "USD", "date": "2022-09-01", "rates": {"EUR": 0.99, "JPY": 140.0}}',
        '{"amount": 1.0, "base": "EUR", "date": "2022-09-02", "rates": {"USD": 1.01}}',
        '{"amount": 1.0, "base": "USD", "date": "2022-09-02", "rates": {}}',
    )
    rows = sorted((str(r["rate_date"]), r["code"], r["rate"]) for r in rates.read_rates(spark, path).collect())
    assert rows == [("2022-09-01", "EUR", 0.99), ("2022-09-01", "JPY", 140.0)]
