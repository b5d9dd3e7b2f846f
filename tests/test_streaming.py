"""Streams: restarts, replays, end markers, tombstones."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowlens.operators.aggregates import row_count
from flowlens.operators.validate import same_multiset
from flowlens.plans import questions as batch
from flowlens.schema import TRANSACTIONS
from flowlens.session import run_folder, settings
from flowlens.streaming import ingest, questions, replays, runs
from flowlens.streaming.completion import CompletedClients


def drop(spark, folder, rows, schema):
    """One more file in a source folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


MESSAGE = "client_id string, sender string, msg_id bigint, arrival bigint"


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    source, folder = str(tmp_path / "in"), run_folder(spark, "restart")
    seen = []

    def once_failing(df, number):
        if number == 1 and not seen:
            seen.append(number)
            raise RuntimeError("executor lost")
        return {"rows": df}

    drop(spark, source, [(1,)], "v int")
    runs.run(ingest.stream_parquet(spark, source, "v int", 1), folder, once_failing)
    drop(spark, source, [(2,)], "v int")
    with pytest.raises(Exception):
        runs.run(ingest.stream_parquet(spark, source, "v int", 1), folder, once_failing)
    drop(spark, source, [(3,)], "v int")
    runs.run(ingest.stream_parquet(spark, source, "v int", 1), folder, once_failing)
    schema = spark.createDataFrame([], "v int").schema
    assert sorted(r["v"] for r in runs.appended(spark, folder, "rows", schema).collect()) == [1, 2, 3]


def test_aggregate_goes_on_after_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), run_folder(spark, "count")
    for values, total in (([(1,), (2,)], 2), ([(3,)], 3)):
        drop(spark, source, values, "v int")
        stream = ingest.stream_parquet(spark, source, "v int", 1)
        assert questions.count_stream(stream, folder).first()["count"] == total


def test_no_input_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = ingest.stream_parquet(spark, str(tmp_path / "in"), "v string")
    assert questions.rows_of(stream, run_folder(spark, "none")).count() == 0
    assert questions.count_stream(stream, run_folder(spark, "none")).collect()[0]["count"] == 0
    groups = spark.createDataFrame([("a",), ("b",)], "v string")
    counts = questions.count_stream(stream, run_folder(spark, "none"), ["v"], groups).collect()
    assert sorted(map(tuple, counts)) == [("a", 0), ("b", 0)]


def test_high_mark_over_batches(spark, tmp_path):
    """Late and repeated numbers go, per client and sender; without sender or number all stay."""
    first = [("c", "s", 1, 1), ("c", "s", 3, 2), ("c", "s", 2, 3), ("c", "t", 1, 4), ("d", "s", 1, 5), ("c", None, 1, 6)]
    second = [("c", "s", 3, 7), ("c", "s", 4, 8), ("c", "s", 4, 9), ("c", "t", 2, 10), ("c", None, 1, 11), ("c", "s", None, 12)]
    want = [1, 2, 4, 5, 6, 8, 10, 11, 12]
    df = spark.createDataFrame(first + second, MESSAGE)
    for block in (1, 3, 100):
        got = replays.above_high_mark(df, "arrival", block=block)
        assert sorted(r["arrival"] for r in got.collect()) == want
    source, folder = str(tmp_path / "in"), run_folder(spark, "mark")
    for part in (first, second):
        drop(spark, source, part, MESSAGE)
        stream = ingest.stream_parquet(spark, source, MESSAGE, 1)
        runs.run(stream, folder, replays.high_mark_branches("arrival", folder, block=3))
    rows = runs.appended(spark, folder, "rows", df.schema)
    assert sorted(r["arrival"] for r in rows.collect()) == want


def test_repeats_over_batches(spark, tmp_path):
    rows = [("c", "s", 1, 0), ("c", "s", 2, 0), ("c", None, 1, 0), ("c", "s", None, 0)]
    source, folder = str(tmp_path / "in"), run_folder(spark, "repeats")
    for _ in range(2):
        drop(spark, source, rows, MESSAGE)
        stream = replays.drop_repeats(ingest.stream_parquet(spark, source, MESSAGE, 1))
        table = questions.rows_of(stream, folder)
    assert table.count() == 2 + 4
    assert replays.drop_repeats(spark.createDataFrame(rows * 2, MESSAGE)).count() == 6


def test_repeats_within_a_watermark(spark, tmp_path):
    schema = "client_id string, sender string, msg_id bigint, at timestamp"
    rows = spark.range(6).selectExpr(
        "'c' AS client_id", "'s' AS sender", "id % 3 AS msg_id", "timestamp_seconds(id) AS at"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_parquet(spark, str(tmp_path / "in"), schema)
    table = questions.rows_of(
        replays.drop_repeats(stream, watermark=("at", "1 hour")), run_folder(spark, "within")
    )
    assert table.count() == 3


KIND = "client_id string, type string, sender string, msg_id bigint"


def counting_job(folder, expected=2):
    return CompletedClients(
        folder,
        partial=lambda rows: row_count(rows, ["client_id"]),
        merge=lambda parts, complete: complete.join(
            parts.groupBy("client_id").agg(F.sum("count").alias("count")), "client_id", "left"
        ).fillna(0, ["count"]),
        schema="client_id string, count bigint",
        expected_markers=expected,
    )


def test_answers_when_complete(spark, tmp_path):
    source, job = str(tmp_path / "in"), counting_job(run_folder(spark, "complete"))

    sent = []

    def deliver(*rows, again=0):
        """Rows with new numbers, and the last ones of before once more."""
        old = sent[len(sent) - again :]
        new = [(client, kind, "s", len(sent) + i) for i, (client, kind) in enumerate(rows)]
        sent.extend(new)
        drop(spark, source, old + new + new, KIND)
        job.run(ingest.stream_parquet(spark, source, KIND, 1))
        return {r["client_id"]: r["count"] for r in job.answer(spark).collect()}

    assert deliver(("a", "raw_transactions"), ("a", "eof"), ("b", "eof"), ("z", "raw_transactions")) == {}
    assert deliver(again=4) == {}  # one marker of each, however often it comes
    assert deliver(("a", "raw_transactions"), ("a", "eof"), ("b", "eof"), again=2) == {"a": 2, "b": 0}
    assert deliver(("a", "delete_client"), ("z", "eof")) == {"b": 0}
    assert deliver(("a", "raw_transactions"), ("a", "eof"), ("a", "eof")) == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        counting_job("x", expected=0)
    later = counting_job(job.folder)  # another process
    assert {r["client_id"]: r["count"] for r in later.answer(spark).collect()} == {"a": 1, "b": 0}


def sample(tx):
    return tx(
        *(
            {
                "ts": f"2022-09-{day:02d}T0{i}:00",
                "from_bank": str(i % 3),
                "from_account": f"a{i}",
                "to_bank": str(day % 3),
                "to_account": f"a{day % 4}",
                "amount_received": 10.0 * i,
                "amount_paid": 0.5 * i * day,
                "payment_currency": "US Dollar" if i else "Euro",
                "payment_format": "Wire" if day % 2 else "ACH",
            }
            for day in range(1, 16)
            for i in range(8)
        )
    )


def test_streams_equal_batch(spark, tx, tmp_path):
    source, df = str(tmp_path / "in"), sample(tx)
    df.repartition(3).write.parquet(source)
    usd = batch.in_currency(df)
    p = batch.Parameters(divisor=2)

    def stream():
        return ingest.stream_parquet(spark, source, TRANSACTIONS, 1)

    def folder():
        return run_folder(spark, "equal")

    from flowlens.operators import aggregates, graph

    usd_stream = batch.in_currency(stream())
    assert same_multiset(questions.small_payment_stream(stream(), folder()), batch.small_payments(usd))
    assert same_multiset(
        questions.bank_maximum_stream(usd_stream, folder()), aggregates.largest_per_group(usd)
    )
    assert same_multiset(
        questions.far_below_average_stream(stream, folder(), p), batch.far_below_average(usd, p)
    )
    bounded = questions.two_hop_stream(stream(), stream(), time="ts", delay="30 days", horizon="30 days")
    paths = aggregates.merge_pair_counts(questions.rows_of(bounded, folder()), 1)
    assert same_multiset(paths, graph.two_hop_pairs(df))
    assert same_multiset(questions.two_hop_pairs_stream(stream(), folder()), graph.two_hop_pairs(df))
    q4 = batch.Parameters(min_destinations=2, min_paths=2)
    assert same_multiset(questions.scatter_gather_stream(stream(), folder(), q4), batch.scatter_gather(usd, q4))
    assert batch.scatter_gather(usd, q4).count() > 0


def test_csv_stream(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Timestamp,Account,Account,Amount Paid\n2022/09/01 00:17,x,y,2.5\n")
    (folder / "b.csv").write_text("Timestamp,Account,Account,Amount Paid\n2022/09/01 00:18,z,w,\n")
    table = questions.rows_of(ingest.stream_transactions(spark, str(folder), max_files=1), run_folder(spark, "csv"))
    rows = table.select("from_account", "to_account", "amount_paid").collect()
    assert sorted(map(tuple, rows)) == [("x", "y", 2.5), ("z", "w", None)]


def test_csv_files_of_other_layouts_land_in_batches(spark, tmp_path):
    source, landed = tmp_path / "in", run_folder(spark, "landed")
    source.mkdir()

    def land(name, text):
        (source / name).write_bytes(text.encode())
        return ingest.land_transactions(spark, str(source), landed, max_files=1)

    land("a.csv", "Timestamp,Account,Account,Amount Paid\n2022/09/01 00:17,x,y,2.5\n")
    land("b 1%.csv", "\ufeffAmount Paid,From Bank,Account\n,7,z\n")
    land("only header.csv", "Account,From Bank\n")
    land("empty.csv", "")
    rows = land("c.csv", "Account,Account,Amount Paid\nAccount,Account,Amount Paid\n")
    got = {(r["from_account"], r["to_account"], r["from_bank"], r["amount_paid"], r["batch"]) for r in rows.collect()}
    assert got == {("x", "y", None, 2.5, 0), ("z", None, "7", None, 1), ("Account", "Account", None, None, 4)}
    # nothing new: nothing is read again
    assert ingest.land_transactions(spark, str(source), landed).count() == 3
    further = ingest.stream_parquet(spark, f"{landed}/rows", rows.schema, 1).drop("batch")
    assert questions.rows_of(further, run_folder(spark, "further")).count() == 3


def test_accounts_land(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number\nB,007,x\n")
    rows = ingest.land_accounts(spark, str(tmp_path), run_folder(spark, "landed")).drop("batch")
    assert [r["bank_name"] for r in rows.collect()] == ["B"]


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_a_batch_leaves_no_shuffle_files(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(1000).repartition(4).write.parquet(source)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        spark.range(500).withColumn("half", F.col("id") * 2).repartition(2).write.parquet(str(tmp_path / "table"))
        before = shuffle_files(spark)
        looked_up = ingest.stream_parquet(spark, source, "id bigint", 1).join(spark.read.parquet(str(tmp_path / "table")), "id")
        folder, during = run_folder(spark, "shuffled"), []

        def branches(batch, _):
            during.append(batch.rdd.count() and len(shuffle_files(spark) - before))
            return {"rows": batch}

        runs.run(looked_up, folder, branches)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and len(during) == 4 and min(during) > 0
    assert runs.appended(spark, folder, "rows", looked_up.schema).count() == 500


def test_used_up_files_go(spark, tmp_path):
    source, folder = tmp_path / "in", run_folder(spark, "used-up")
    spark.range(100).repartition(4).write.parquet(str(source))
    found = questions.rows_of(ingest.stream_parquet(spark, str(source), "id bigint", 1, used_up=True), folder)
    assert found.count() == 100
    assert len(list(source.glob("part-*"))) <= 2  # the last batch's, and one that may still be going
