"""Answers, marks and cancellations kept as state of the stream, with results while it runs.

State lives in the RocksDB state store, so it may outgrow memory and comes back after a lost executor.
Clients, or clients and senders, are dealt by their hash to shelves and there to drawers. A shelf is one call
of Python, which works through many clients at once as tables. A drawer is one entry of the state; a shelf
gets twice as many when they become large, and a micro-batch reads and writes those it touches only. Rows
travel to their shelf in parcels. They are summed up by key before: a client with a third of all rows brings a
few partial rows per task to its state.

A micro-batch is one moment. Of its messages a tombstone comes last: it takes what its client sent up
to and including that batch, and what comes later starts afresh. End markers come after the rows of
their batch. Message numbers count as coming in their own order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.session import RECOMMENDED_CONF
from flowlens.sources.envelopes import CANCEL_TYPE, END_TYPE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: For `runs.start`: Spark's default store can't hold this state, in sessions that weren't built with the
#: recommended settings.
STATE_CONF = {_PROVIDER: RECOMMENDED_CONF[_PROVIDER]}
#: For runs that soon end: a store is closed with its task, so that its local files don't outlast the run. Its
#: rows aren't counted, which takes a look-up for each that is written.
SHORT_RUN_CONF = {
    **STATE_CONF,
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}

# Fixed, since a stream's state outlives its session.
SHELVES = 256
# Bytes above which a shelf's drawers are split on average, and drawers that a shelf may get.
DRAWER_BYTES, DRAWERS = 1 << 18, 1024
# Rows, or bytes, that a task puts into parcels at once; rows of a parcel that leaves the state.
PACKED_ROWS, PACKED_BYTES, OUT_ROWS = 100_000, 16 << 20, 10_000
_PARCEL = T.StructType([T.StructField("_shelf", T.IntegerType()), T.StructField("parcel", T.BinaryType())])
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}


@dataclass(frozen=True)
class Tally:
    """What is added up per client and `keys`: the number of rows, sums of columns (NULL as zero),
    and the largest of a column (NULL as zero) with the smallest name that has it."""

    keys: tuple[str, ...] = ()
    rows: str = "count"
    sums: tuple[str, ...] = ()
    largest: str | None = None
    named_by: str | None = None
    _values: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        if (self.largest is None) != (self.named_by is None):
            raise ValueError("largest and named_by go together")
        top = (self.largest, self.named_by) if self.largest else ()
        object.__setattr__(self, "_values", (self.rows, *self.sums, *top))

    @property
    def values(self) -> T.StructType:
        kinds = [T.LongType(), *(T.DoubleType() for _ in self.sums)]
        kinds += [T.DoubleType(), T.StringType()] if self.largest else []
        return T.StructType([T.StructField(n, k) for n, k in zip(self._values, kinds)])

    @property
    def groups(self) -> T.StructType:
        # the state store wants at least one column in a key
        return T.StructType([T.StructField(k, T.StringType()) for k in self.keys or ("everything",)])

    def of_rows(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows as partial rows of one row each."""
        part = {k: rows[k] for k in self.keys}
        part[self.rows] = np.ones(len(rows), np.int64)
        part.update({s: rows[s].astype(float).fillna(0.0) for s in self.sums})
        if self.largest:
            part.update({self.largest: rows[self.largest].astype(float).fillna(0.0), self.named_by: rows[self.named_by]})
        return pd.DataFrame(part, index=rows.index)

    def merged(self, parts: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
        """Partial rows with one key added up."""
        by = list(by)
        if self.largest:
            parts = parts.sort_values([self.largest, self.named_by], ascending=[False, True], na_position="last", kind="stable")
        added = parts.groupby(by, dropna=False, sort=False)[[self.rows, *self.sums]].sum().reset_index()
        if self.largest:
            # groups stand in the order of their first rows, which hold the largest
            first = parts.drop_duplicates(by)
            for column in (self.largest, self.named_by):
                added[column] = first[column].to_numpy()
        return added


def _plain(value):
    """A value as the state store takes it."""
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    return value.item() if isinstance(value, np.generic) else value


def _for_spark(frame: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """The columns of the schema; text as plain objects, since joined Arrow strings are refused."""
    out = frame.reindex(columns=schema.fieldNames())
    for column in schema:
        if column.dataType == T.StringType():
            out[column.name] = out[column.name].astype(object).where(out[column.name].notna(), None)
        elif column.dataType == T.LongType():
            out[column.name] = out[column.name].astype("int64")
    return out


def _arrow(frame: pd.DataFrame, schema: T.StructType) -> pa.Table:
    kinds = pa.schema([(f.name, _ARROW[f.dataType]) for f in schema])
    return pa.Table.from_pandas(_for_spark(frame, schema), kinds, preserve_index=False).replace_schema_metadata()


def _hashed(messages: DataFrame, *keys: str) -> DataFrame:
    return messages.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(*keys), 33).cast("int"))


def _sealed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _opened(parcels: Iterator[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(p)).read_all() for p in parcels])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, many at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if sum(map(len, held)) >= PACKED_ROWS or size >= PACKED_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _cut(rows: pa.Table, of: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each number, in its order."""
    order = np.argsort(of, kind="stable")
    rows, of = rows.take(pa.array(order)).combine_chunks().replace_schema_metadata(), of[order]
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    for at, stop in zip(begin, [*begin[1:], len(of)]):
        yield int(of[at]), rows.slice(at, stop - at)


def _packed(rows: pa.Table) -> pa.RecordBatch:
    """Rows with their `_hash`, one parcel per shelf."""
    shelves = list(_cut(rows, rows["_hash"].to_numpy() % SHELVES))
    columns = [pa.array([n for n, _ in shelves], pa.int32()), pa.array([_sealed(some) for _, some in shelves], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _PARCEL.names)


class _Drawers:
    """The drawers of a shelf, each a table of rows with their `_hash` in one entry of the state."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.width = handle.getValueState("width", "drawers int")
        self.state = handle.getMapState("drawers", "drawer int", "parcel binary")

    def start(self) -> None:
        """To be called for each shelf."""
        self.wide = self.width.get()[0] if self.width.exists() else 1
        self.open: dict[int, bool] = {}  # and whether there was anything in it

    def opened(self, rows: pa.Table) -> list[pa.Table]:
        """What is in the drawers that these rows belong to and that weren't opened yet."""
        found = []
        for number in np.unique(self._numbers(rows, self.wide)).tolist():
            if number not in self.open:
                value = self.state.getValue((number,))
                self.open[number] = value is not None
                found += [_opened([value[0]])] if value is not None else []
        return found

    def put(self, rows: pa.Table) -> None:
        """What the opened drawers hold from now on."""
        sizes = {number: self._update(number, some) for number, some in _cut(rows, self._numbers(rows, self.wide))}
        for number, filled in self.open.items():
            if filled and number not in sizes:
                self.state.removeKey((number,))
        if sum(sizes.values()) > len(sizes) * DRAWER_BYTES and self.wide < DRAWERS:
            self._widen()

    def _numbers(self, rows: pa.Table, wide: int) -> np.ndarray:
        return rows["_hash"].to_numpy() // SHELVES % wide

    def _update(self, number: int, rows: pa.Table) -> int:
        parcel = _sealed(rows)
        self.state.updateValue((number,), (parcel,))
        return len(parcel)

    def _widen(self) -> None:
        """Every drawer into two."""
        for number in range(self.wide):
            value = self.state.getValue((number,))
            if value is None:
                continue
            rows = _opened([value[0]])
            sizes = {n: self._update(n, some) for n, some in _cut(rows, self._numbers(rows, 2 * self.wide))}
            if number not in sizes:
                self.state.removeKey((number,))
        self.width.update((2 * self.wide,))


class _UntilComplete(StatefulProcessor):
    """Adds up partial rows of clients until their markers are there, then gives them all away. What a
    drawer holds are partial rows too, markers among them."""

    def __init__(self, tally: Tally, client: str, expected: int, partial: T.StructType, out: T.StructType):
        self.tally, self.client, self.expected, self.partial, self.out = tally, client, expected, partial, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.drawers = _Drawers(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tally, parts, before = self.tally, [], []
        by = ["_hash", self.client, "message_kind", *tally.groups.fieldNames()]
        self.drawers.start()
        for some in rows:
            table = _opened(some["parcel"])
            before += self.drawers.opened(table)
            parts.append(table.to_pandas())
            if len(parts) > 1:  # no more than one row per group, and what came last
                parts = [tally.merged(pd.concat(parts), by)]
        now = tally.merged(pd.concat([*parts, *([pa.concat_tables(before).to_pandas()] if before else [])]), by)
        who, kind = pd.factorize(now[self.client], use_na_sentinel=False)[0], now["message_kind"]
        cancelled = np.isin(who, who[kind == CANCEL_TYPE])
        ends = np.bincount(who, np.where(kind == END_TYPE, now[tally.rows], 0))[who]
        complete = ~cancelled & (ends >= self.expected)
        held = now[~cancelled & ~complete]
        if len(held) or before:
            self.drawers.put(_arrow(held, self.partial))
        found = now[complete & (kind == "row")]
        if not tally.keys:
            ended = now[complete & (kind == END_TYPE)]
            zero = {v.name: 0 if v.dataType != T.StringType() else None for v in tally.values}
            found = pd.concat([found, ended[~np.isin(who[ended.index], who[found.index])].assign(**zero)])
        if len(found):
            yield _for_spark(found, self.out)

    def close(self) -> None:
        pass


def completed(
    messages: DataFrame, tally: Tally, expected_markers: int = 1, client: str = "client_id", kind: str = "type"
) -> DataFrame:
    """A stream of the answers of each client, one row per group, that come in the micro-batch in
    which the client's last end marker does. What it sends after that counts for its next answer.
    A complete client without rows has the number zero, if there are no groups."""
    if expected_markers <= 0:
        raise ValueError("expected_markers must be positive")
    name = T.StructField(client, T.StringType())
    kinds = [T.StructField("_hash", T.IntegerType()), name, T.StructField("message_kind", T.StringType())]
    partial = T.StructType([*kinds, *tally.groups.fields, *tally.values.fields])
    numbers = [*tally.sums, *([tally.largest] if tally.largest else [])]
    texts = dict.fromkeys([client, kind, *tally.keys, *([tally.named_by] if tally.named_by else [])])

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some.to_pandas() for some in _gathered(batches)):
            ends = rows[kind].isin([END_TYPE, CANCEL_TYPE])
            marks = rows[ends].groupby(["_hash", client, kind], dropna=False, sort=False).size().rename(tally.rows).reset_index()
            marks = marks.rename(columns={kind: "message_kind"})
            plain = rows[~ends]
            parts = tally.of_rows(plain).assign(**{c: plain[c] for c in ("_hash", client)}, message_kind="row")
            if not tally.keys:
                parts["everything"] = None
            both = [tally.merged(parts, ["_hash", client, "message_kind", *tally.groups.fieldNames()])] if len(parts) else []
            both += [marks] if len(marks) else []
            yield _packed(_arrow(pd.concat(both), partial))

    out = T.StructType([name, *tally.groups.fields[: len(tally.keys)], *tally.values.fields])
    asked = [*(F.col(c).cast("string").alias(c) for c in texts), *(F.col(c).cast("double").alias(c) for c in numbers)]
    summed = _hashed(messages.select(*asked), client).mapInArrow(partials, _PARCEL)
    return summed.groupBy("_shelf").transformWithStateInPandas(
        _UntilComplete(tally, client, expected_markers, partial, out), outputStructType=out, outputMode="Append", timeMode="None"
    )


class _HighMark(StatefulProcessor):
    """A drawer holds the marks of its clients and senders."""

    def __init__(self, who: Sequence[str], number: str):
        self.who, self.number = list(who), number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.drawers = _Drawers(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.drawers.start()
        known = None  # clients and senders, then their marks before this batch, NULL if there are none
        of_seen, seen = np.empty(0, np.int64), np.empty(0, np.int64)  # numbers of this batch
        for some in rows:
            table = _opened(some["parcel"])
            whos = pa.table({c: table[c] for c in (*self.who, "_hash")})
            unmarked = whos.append_column("top", pa.nulls(len(whos), pa.int64()))
            known = pa.concat_tables([*([known] if known else []), *self.drawers.opened(whos), unmarked])
            of, first = self._numbered(known)
            of, known = of[len(known) - len(table) :], known.take(pa.array(first))
            numbers, mark = table[self.number].to_numpy().astype(np.int64), known["top"].combine_chunks()
            least = mark.fill_null(0).to_numpy()
            fresh = np.flatnonzero(mark.is_null().to_numpy(zero_copy_only=False)[of] | (numbers > least[of]))
            met = pd.DataFrame({"of": np.append(of_seen, of[fresh]), "number": np.append(seen, numbers[fresh])})
            once = ~met.duplicated().to_numpy()
            fresh = fresh[once[len(seen) :]]
            of_seen, seen = np.append(of_seen, of[fresh]), np.append(seen, numbers[fresh])
            if len(fresh):
                found = table.drop_columns(["_hash"]).take(pa.array(fresh)).combine_chunks().replace_schema_metadata()
                yield pd.DataFrame({"parcel": [_sealed(found.slice(at, OUT_ROWS)) for at in range(0, len(found), OUT_ROWS)]})
        if len(seen):
            top = np.where(known["top"].is_null(), np.iinfo(np.int64).min, known["top"].fill_null(0))
            np.maximum.at(top, of_seen, seen)
            self.drawers.put(known.set_column(known.schema.get_field_index("top"), "top", pa.array(top)))

    def _numbered(self, whos: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows by number of their client and sender, in the order of first rows, and these rows."""
        number = np.zeros(len(whos), np.int64)
        for column in self.who:
            codes = whos[column].combine_chunks().dictionary_encode("encode")
            number = pd.factorize(number * (len(codes.dictionary) + 1) + codes.indices.to_numpy())[0]
        return number, np.unique(number, return_index=True)[1]

    def close(self) -> None:
        pass


def above_live_mark(messages: DataFrame, key: Sequence[str] = ("client_id", "sender", "msg_id")) -> DataFrame:
    """A stream of the messages whose number exceeds every one of their client and sender in earlier
    micro-batches, each number once. Messages without sender or number always pass. The state is one
    number per client and sender, however many messages there were."""
    *who, number = key
    known = F.col(who[-1]).isNotNull() & F.col(number).isNotNull()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_packed, _gathered(batches))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parcel in batch.column("parcel"):
                yield from _opened([parcel.as_buffer()]).to_batches()

    dealt = _hashed(messages.where(known), *who).mapInArrow(packed, _PARCEL)
    fresh = dealt.groupBy("_shelf").transformWithStateInPandas(
        _HighMark(who, number), outputStructType=T.StructType(_PARCEL.fields[1:]), outputMode="Append", timeMode="None"
    )
    return fresh.mapInArrow(unpacked, messages.schema).unionByName(messages.where(~known))
