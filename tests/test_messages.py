"""Message texts as a stream, Q2 over two streams of messages, exports in fixed shards."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from flowlens.session import run_folder
from flowlens.sources.envelopes import CANCEL_TYPE, END_TYPE
from flowlens.sources.shards import manifest, read_shard, write_shards
from flowlens.streaming.ingest import stream_parquet
from flowlens.streaming.messages import CONTROL, QUARANTINED, envelope_stream, named_maxima_of_two, stream_lines
from flowlens.streaming.runs import numbered

ROW = T.StructType().add("bank", "string").add("amount", "double")
NAME = T.StructType().add("bank_id", "string").add("bank_name", "string")


def text(kind, number, batch=None, size=None, client="a"):
    message = {"type": kind, "client": client, "sender": "g", "msg_id": number}
    if batch is not None:
        message["payload"] = {"batch_size": len(batch) if size is None else size, "batch": batch}
    return json.dumps(message)


def test_every_message_lands_in_one_table(spark):
    good = [
        text("raw_transactions", 1, [{"bank": "1", "amount": 2.5}, {"bank": None, "amount": "x"}]),
        text("raw_transactions", 2, []),
        text("raw_accounts", 3, [{"bank_id": "7", "bank_name": "N"}]),
        text(END_TYPE, 4),
    ]
    bad = [
        text("raw_transactions", 5, [{"bank": "1"}], size=2),
        text("raw_transactions", 6),
        text("raw_accounts", 7, [5]),
        text("", 8),
        '{"type": "raw_tr',
        "no json",
        "",
    ]
    source, path = run_folder(spark, "lines"), run_folder(spark, "out")
    for some in (good[:2] + bad[:3], good[2:] + bad[3:]):  # one micro-batch each
        spark.createDataFrame([(t,) for t in some], "value string").coalesce(1).write.mode("append").text(source)
        found = envelope_stream(stream_lines(spark, source), path, {"raw_transactions": ROW, "raw_accounts": NAME})
    rows = {k: sorted(map(tuple, v.collect()), key=str) for k, v in found.items()}
    assert rows["raw_transactions"] == [("a", "g", 1, "1", 2.5, 0), ("a", "g", 1, None, None, 0)]
    assert rows["raw_accounts"] == [("a", "g", 3, "7", "N", 1)]
    assert [(r[0], r[3], r[-1]) for r in rows[CONTROL]] == [(END_TYPE, 4, 1)]
    assert sorted(r[-2] for r in rows[QUARANTINED]) == sorted(bad)


PAYMENT = "client_id string, type string, sender string, msg_id bigint, from_bank string, from_account string, amount_paid double"
ACCOUNT = "client_id string, type string, sender string, msg_id bigint, bank_id string, bank_name string"


def pay(client, bank, account, amount):
    return (client, "raw_transactions", None, None, bank, account, amount)


def name(client, bank, called):
    return (client, "raw_accounts", None, None, bank, called)


def control(client, number, schema, kind=END_TYPE):
    return (client, kind, "g", number) + (None,) * (len(schema.split(",")) - 4)


def test_either_stream_waits_for_the_other(spark):
    def paid(client, number, kind=END_TYPE):
        return control(client, number, PAYMENT, kind)

    def known(client, number, kind=END_TYPE):
        return control(client, number, ACCOUNT, kind)

    steps = [
        # a: names first; b: payments first, their marker twice; c: is cancelled by the accounts
        ([pay("a", "01", "x", 5.0), pay("b", "2", "k", None), paid("b", 1), pay("c", "1", "q", 9.0), paid("c", 1)],
         [name("a", "1", "M"), name("a", "001", "N"), known("a", 1)]),
        ([pay("a", "01", "w", 5.0), pay("a", "3", "y", 1.0), paid("a", 1), paid("b", 1)], [known("c", 1, CANCEL_TYPE), known("a", 1)]),
        ([], [name("b", "2", "P"), known("b", 1)]),
        ([pay("c", "1", "r", 2.0), paid("c", 2)], [known("c", 2)]),
    ]
    sources, path = (run_folder(spark, "payments"), run_folder(spark, "accounts")), run_folder(spark, "out")
    for step in steps:
        for source, rows, schema in zip(sources, step, (PAYMENT, ACCOUNT)):
            spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        streams = (stream_parquet(spark, s, schema) for s, schema in zip(sources, (PAYMENT, ACCOUNT)))
        schema = named_maxima_of_two(*streams, path)
    got = sorted(map(tuple, numbered(spark, path, "rows", schema).collect()))
    assert [tuple(r) for r in got] == [
        ("a", "01", "w", "N", 5.0, 1),
        ("a", "3", "y", "Unknown", 1.0, 1),
        ("b", "2", "k", "P", 0.0, 2),
        ("c", "1", "r", "Unknown", 2.0, 3),
    ]


def test_shards(spark):
    """A third of all rows under one key, keys of NULL, more shards than keys."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), "id"
    )
    path = run_folder(spark, "shards")
    write_shards(rows, ["k"], 16, path, rows_per_file=200)
    lines = manifest(spark, path).orderBy("shard").collect()
    assert [r["shard"] for r in lines] == list(range(1, 17))
    assert max(r["most_rows"] for r in lines) <= 200 and min(r["rows"] for r in lines) == 0
    shards = [sorted(map(tuple, read_shard(spark, path, r["shard"], rows.schema).collect()), key=str) for r in lines]
    assert [len(s) for s in shards] == [r["rows"] for r in lines]
    assert sorted(sum(shards, []), key=str) == sorted(map(tuple, rows.collect()), key=str)
    keys = [{k for k, _ in s} for s in shards]
    assert sum(map(len, keys)) == len(set().union(*keys))  # a key lies in one shard
    with pytest.raises(ValueError):
        read_shard(spark, path, 17, rows.schema)
    with pytest.raises(AnalysisException):
        write_shards(rows, ["k"], 16, path)
    with pytest.raises(ValueError):
        write_shards(rows.withColumn("Shard", F.lit(1)), ["k"], 2, run_folder(spark, "shards"))


def test_no_rows_in_shards(spark):
    path, empty = run_folder(spark, "shards"), spark.createDataFrame([], "k string, n int")
    write_shards(empty, ["k"], 3, path)
    assert [(r["shard"], r["rows"]) for r in manifest(spark, path).orderBy("shard").collect()] == [(1, 0), (2, 0), (3, 0)]
    assert read_shard(spark, path, 2, empty.schema).count() == 0
