"""Live state: answers as soon as the markers are there, tombstones, marks, failures within a batch."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from flowlens.catalog import streams  # noqa: F401  (registers the streams)
from flowlens.catalog.queries import QUERIES
from flowlens.session import run_folder
from flowlens.sources.envelopes import CANCEL_TYPE, END_TYPE
from flowlens.streaming import live
from flowlens.streaming.ingest import stream_parquet
from flowlens.streaming.live import SHORT_RUN_CONF, Tally, above_live_mark, completed
from flowlens.streaming.replays import drop_repeats
from flowlens.streaming.runs import committed, numbered, run

SCHEMA = "client_id string, type string, sender string, msg_id bigint, bank string, amount double, account string"


def end(client, number):
    return (client, END_TYPE, "s", number, None, None, None)


def pay(client, number, bank, amount, account):
    return (client, "row", "s", number, bank, amount, account)


def steps_through(spark, steps, made):
    """Each step is written and run by itself, so the state comes back from the checkpoint."""
    source, path = run_folder(spark, "in"), run_folder(spark, "out")
    for step in steps:
        spark.createDataFrame(step, SCHEMA).repartition(2).write.mode("append").parquet(source)
        out = made(stream_parquet(spark, source, SCHEMA))
        run(out, path)
    return sorted(map(tuple, numbered(spark, path, "rows", out.schema).collect()), key=str)


def test_answers_come_with_the_last_marker(spark):
    steps = [
        [pay("a", 1, "b1", 5.0, "x"), pay("a", 1, "b1", 5.0, "x"), pay("b", 1, None, None, "z"), end("a", 2)],
        [pay("a", 3, "b1", 5.0, "w"), end("a", 4), ("b", CANCEL_TYPE, None, None, None, None, None), end("b", 9), end("b", 10)],
        [pay("b", 2, "b2", 1.0, "k"), end("b", 5), end("b", 6), pay("a", 7, "b1", 9.0, "v")],
        [end("a", 8), end("a", 9), pay("b", 11, None, None, "y"), end("b", 12), end("b", 13)],
    ]
    tally = Tally(("bank",), "count", (), "amount", "account")
    got = steps_through(spark, steps, lambda s: completed(drop_repeats(s), tally, 2))
    # a tombstone takes the rows and both markers of its own batch; NULL is a group like others
    want = [("a", "b1", 2, 5.0, "w", 1), ("b", "b2", 1, 1.0, "k", 2), ("a", "b1", 1, 9.0, "v", 3), ("b", None, 1, 0.0, "y", 3)]
    assert got == sorted(want, key=str)


def test_count_of_a_client_without_rows(spark):
    steps = [[end("a", 1), pay("b", 1, "x", 1.0, "k")], [end("b", 2), pay("c", 1, "x", 1.0, "k")]]
    got = steps_through(spark, steps, lambda s: completed(s, Tally(sums=("amount",)), 1))
    assert got == [("a", 0, 0.0, 0), ("b", 1, 1.0, 1)]


def test_marks(spark):
    steps = [
        [pay("a", 5, "1", None, None), pay("a", 5, "1", None, None), pay("a", 3, "2", None, None), pay("b", 1, "3", None, None)],
        [pay("a", 5, "4", None, None), pay("a", 4, "5", None, None), pay("a", 6, "6", None, None), ("a", "row", None, 1, "7", None, None)],
        [pay("a", 6, "8", None, None), pay("b", 2, "9", None, None), ("a", "row", "s", None, "10", None, None)],
    ]
    got = steps_through(spark, steps, above_live_mark)
    assert sorted((int(r[4]), r[-1]) for r in got) == [(1, 0), (2, 0), (3, 0), (6, 1), (7, 1), (9, 2), (10, 2)]


def test_markers_and_names_are_checked(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        completed(rows, Tally(), 0)
    with pytest.raises(ValueError):
        Tally(largest="amount")


def test_readers_see_whole_batches_only(spark):
    source, path = run_folder(spark, "in"), run_folder(spark, "out")
    spark.range(10).write.parquet(source)

    def branches(fails):
        gone = F.raise_error(F.lit("gone")).isNull() if fails else F.lit(True)
        return lambda batch, _: {"one": batch, "two": batch.where(gone)}

    for fails, rows in ((True, 0), (False, 10)):
        stream = stream_parquet(spark, source, "id bigint")
        if fails:
            with pytest.raises(Exception, match="gone"):
                run(stream, path, branches(fails), atomic=True)
            assert numbered(spark, path, "one", stream.schema).count() == 10  # written, but not to be seen
        else:
            run(stream, path, branches(fails), atomic=True)
        assert [committed(spark, path, b, stream.schema).count() for b in ("one", "two")] == [rows, rows]


@pytest.fixture
def default_state_store(spark):
    """A session that wasn't built with the recommended settings."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, DEFAULT_STORE)
    yield key
    spark.conf.set(key, before)


DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("signup", "view", "purchase", "error"))), (F.col("id") % 4 + 1).cast("int"))
    day = F.expr("timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(cast(id % 28 as int))")
    made = {
        "events": (80, {"event_id": F.col("id"), "ts": day, "user_id": F.col("id") % 3, "event_type": kind, "value": (F.col("id") * 7 % 200).cast("double"), "props": F.lit("")}),
        "orders": (12, {"o_orderkey": F.col("id"), "o_custkey": F.col("id") % 5, "o_orderdate": day, "o_orderpriority": F.lit("1-URGENT")}),
        "lineitem": (12, {"l_orderkey": F.col("id"), "l_suppkey": F.col("id") % 4, "l_returnflag": F.lit("R"), "l_linenumber": F.lit(1), "l_extendedprice": F.col("id").cast("double"), "l_discount": F.lit(0.0)}),
        "nation": (5, {"n_nationkey": F.col("id").cast("int"), "n_name": F.concat(F.lit("bank "), F.col("id").cast("string")), "n_regionkey": F.lit(1)}),
    }
    for name, (rows, columns) in made.items():
        spark.range(rows).select(*(c.alias(n) for n, c in columns.items())).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_live_answers", "stream_live_tombstones", "stream_live_marks", "stream_q2_two_inputs"])
def test_queries_with_the_default_state_store(spark, tables, default_state_store, name):
    assert QUERIES[name](spark, tables).count() > 0
    assert spark.conf.get(default_state_store) == DEFAULT_STORE  # the setting is the query's own


def test_answers_with_the_default_state_store(spark, default_state_store):
    source, path = run_folder(spark, "in"), run_folder(spark, "out")
    for step in ([pay("a", 1, "x", 1.0, "k"), end("b", 1)], [pay("a", 2, "x", 2.0, "k"), end("a", 3)]):
        spark.createDataFrame(step, SCHEMA).write.mode("append").parquet(source)
        answers = completed(stream_parquet(spark, source, SCHEMA), Tally(("bank",), sums=("amount",)), 1)
        run(answers, path, conf=SHORT_RUN_CONF)
    assert [tuple(r) for r in numbered(spark, path, "rows", answers.schema).collect()] == [("a", "x", 2, 3.0, 1)]


class State:
    """A shelf's state in memory, which counts how often it is asked."""

    def __init__(self):
        self.entries, self.value, self.asked = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        self.asked += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self.entries[key]


def given(processor, rows):
    """What a processor returns for the rows of a shelf, which come in parcels of 50 and two chunks."""
    parcels = pd.DataFrame({"parcel": [live._sealed(rows.slice(at, 50)) for at in range(0, len(rows), 50)]})
    half = len(parcels) // 2
    return list(processor.handleInputRows((0,), iter([parcels.iloc[:half], parcels.iloc[half:]]), None))


@pytest.mark.parametrize("size", [None, 2_000])
def test_many_clients_share_looks_at_the_state(monkeypatch, size):
    monkeypatch.setattr(live, "DRAWER_BYTES", size or live.DRAWER_BYTES)
    tally, state, some = Tally(("bank",), "count", (), "amount", "account"), State(), random.Random(1)
    kinds = [T.StructField("_hash", T.IntegerType()), T.StructField("client_id", T.StringType()), T.StructField("message_kind", T.StringType())]
    partial = T.StructType([*kinds, *tally.groups.fields, *tally.values.fields])
    out = T.StructType([kinds[1], *tally.groups.fields, *tally.values.fields])
    processor = live._UntilComplete(tally, "client_id", 3, partial, out)
    processor.init(state)
    clients, held = [None, *(f"c{i}" for i in range(400))], {}
    for _ in range(5):
        rows = []
        for _ in range(1500):
            of, kind = some.randrange(len(clients)), some.choices(["row", END_TYPE, CANCEL_TYPE], [70, 25, 5])[0]
            value = (some.choice(["x", "y", None]), 1, float(some.randrange(5)), some.choice("kl")) if kind == "row" else (None, 1, None, None)
            rows.append((of * live.SHELVES, clients[of], kind, *value))
        want, sent = [], {}
        for _, client, kind, *value in rows:
            sent.setdefault(client, []).append((kind, *value))
        for client, those in sent.items():
            mine = held[client] = held.get(client, []) + those
            if any(kind == CANCEL_TYPE for kind, *_ in mine):
                del held[client]
            elif sum(kind == END_TYPE for kind, *_ in mine) >= 3:
                for bank in {r[1] for r in mine if r[0] == "row"}:
                    group = [r for r in mine if r[0] == "row" and r[1] == bank]
                    top, account = min((-r[3], r[4]) for r in group)
                    want.append((client, bank, len(group), -top, account))
                del held[client]
        asked = state.asked
        found = given(processor, live._arrow(pd.DataFrame(rows, columns=partial.fieldNames()), partial))
        got = [tuple(r) for f in found for r in f.astype(object).itertuples(index=False)]
        assert sorted(got, key=str) == sorted(want, key=str)
        if size is None:
            assert state.asked - asked <= 3  # of 400 clients, each of which took several before
    assert size is None or len(state.entries) > 8


@pytest.mark.parametrize("size", [None, 2_000])
def test_many_marks_share_looks_at_the_state(monkeypatch, size):
    monkeypatch.setattr(live, "DRAWER_BYTES", size or live.DRAWER_BYTES)
    state, some, marks = State(), random.Random(2), {}
    processor = live._HighMark(["client_id", "sender"], "msg_id")
    processor.init(state)
    for step in range(5):
        rows = [(some.choice([None, *range(100)]), some.choice("st"), step * 20 + some.randrange(60)) for _ in range(2000)]
        want = {r for r in rows if r[2] > marks.get(r[:2], -1)}
        for r in want:
            marks[r[:2]] = max(marks.get(r[:2], -1), r[2])
        hashes = pa.array([(0 if r[0] is None else r[0]) * live.SHELVES for r in rows], pa.int32())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))]
        asked = state.asked
        found = given(processor, pa.table([*columns, hashes], ["client_id", "sender", "msg_id", "_hash"]))
        got = [tuple(r.values()) for f in found for r in live._opened(f["parcel"]).to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
        if size is None:
            assert state.asked - asked <= 3
    assert size is None or len(state.entries) > 2
