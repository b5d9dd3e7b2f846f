"""Shards of nearly equal bytes whose cuts never part equal texts: minimax contiguous partition.

Groups of equal texts are ordered by the first 60 bits of their digest and cut into contiguous
shards so that the largest shard is as small as possible. The smallest capacity is found by binary
search with a greedy fill as the check. The order is never brought to one place: the search runs
over totals per digest prefix, and only prefixes that a cut may fall into are split further, each
level being one map-side aggregation with a bounded result. The greedy fill over undivided prefixes
gives a boundary no cut lies before, the fill over freely divisible ones a boundary no cut lies
behind; prefixes between the two are split until none is left, so the cuts are exact.

A group larger than the share of a shard is put first and gets a shard to itself (there are fewer
of these than shards), since otherwise one such group would leave the other shards half empty.

Defined results: a NULL text has no bytes and belongs with the empty texts, every row counts one
byte more than its text. Rows without doc_id or with repeated ids are rows like any others.
Texts that share 60 bits of SHA-256 stay together. An empty table gives no rows; with fewer groups
than shards the last shards are empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.tables import materialize, texts

KEY_BITS = 60
LEVEL_BITS = 12  # a level splits a prefix in 2 ** 12; five levels reach single keys


def sized_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, order_key) per document, without the text."""
    rows = texts(documents)
    raw = F.coalesce(rows["text"], F.lit("")).cast("binary")
    return rows.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.conv(F.substring(F.sha2(raw, 256), 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("order_key"),
    )


class _Pieces:
    """Ordered pieces of the key space: first key, bytes, and whether the piece is a single key."""

    def __init__(self, pieces: list[tuple[int, int, int, bool]]):
        self.pieces = sorted(pieces)  # (first key, bits still undivided, bytes, single)
        self.ends = np.cumsum([p[2] for p in self.pieces]).tolist()
        self.total = self.ends[-1] if self.ends else 0

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def fill(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Byte positions of the ends of the shards, filled greedily one after the other."""
        at, ends = 0, []
        for _ in range(shards):
            i = bisect_right(self.ends, at + capacity)  # the first piece that doesn't fit whole
            if i >= len(self.ends):
                at = self.total
            elif divisible and not self.pieces[i][3]:
                at = at + capacity
            else:
                at = max(at, self.start(i))
            ends.append(at)
        return ends

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest capacity whose greedy fill places everything."""
        low = max([-(-self.total // shards), *(p[2] for p in self.pieces if p[3] or not divisible)])
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, divisible)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def undecided(self, shards: int) -> list[int]:
        """Pieces of several keys that a cut may fall into."""
        least, most = self.smallest(shards, True), self.smallest(shards, False)
        early, late = self.fill(least, shards, False), self.fill(most, shards, True)
        found = set()
        for k in range(shards - 1):
            i = bisect_right(self.ends, early[k])
            while i < len(self.pieces) and self.start(i) <= late[k]:
                if not self.pieces[i][3]:
                    found.add(i)
                i += 1
        return sorted(found)


def _totals(rows: DataFrame, bits_left: int) -> list[tuple[int, int, int, bool]]:
    """Totals of the key prefixes at this depth; a result of bounded size, made on the map side."""
    shift = F.shiftleft(F.shiftright("order_key", bits_left), bits_left)
    sums = rows.groupBy(shift.alias("first")).agg(
        F.sum("size").alias("bytes"), F.min("order_key").alias("low"), F.max("order_key").alias("high")
    )
    return [
        (r["low"] if r["low"] == r["high"] else r["first"], 0 if r["low"] == r["high"] else bits_left, r["bytes"], r["low"] == r["high"])
        for r in sums.collect()
    ]


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1, 2, ... and the smallest capacity, for rows of (order_key, size).
    Fewer cuts than shards - 1 leave the last shards empty."""
    bits = KEY_BITS - LEVEL_BITS
    pieces = _Pieces(_totals(rows, bits))
    while split := pieces.undecided(shards):
        kept = [p for i, p in enumerate(pieces.pieces) if i not in set(split)]
        chosen = [pieces.pieces[i] for i in split]
        finer = []
        for left in sorted({p[1] for p in chosen}):
            firsts = [p[0] for p in chosen if p[1] == left]
            inside = rows.where(F.shiftleft(F.shiftright("order_key", left), left).isin(firsts))
            finer += _totals(inside, left - LEVEL_BITS)
        pieces = _Pieces(kept + finer)
    capacity = pieces.smallest(shards, False)
    cuts = []
    for end in pieces.fill(capacity, shards, False)[:-1]:
        i = bisect_right(pieces.ends, end)
        if i < len(pieces.pieces):
            cuts.append(pieces.pieces[i][0])
    return cuts, capacity


def oversize_groups(rows: DataFrame, shards: int) -> list[tuple[int, int]]:
    """(order_key, bytes) of groups above the share of a shard, the largest first. Taking one out
    lowers neither the share of the rest nor its shards by more than one, so this is repeated."""
    sums = rows.groupBy("order_key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    found: list[tuple[int, int]] = []
    for key, size in sums.orderBy(F.desc("bytes"), "order_key").limit(shards).collect():
        left = shards - len(found)
        if left < 2 or size * left <= total:
            break
        found.append((key, size))
        total -= size
    return found


def _counted(shards: int):
    """Numbers the rows of each shard within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            firsts = np.cumsum(counts) - counts
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - firsts[shard[order]] + seen[shard[order]]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shard), part, dtype=np.int32)), pa.array(local)],
                [*batch.schema.names, "part", "local"],
            )

    return run


def slots(rows: DataFrame, shards: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in every shard: a number within the partition, on which the rows
    of earlier partitions are added (prefix sums over one row per partition and shard). The
    numbered rows are written once, so that a repeated task cannot change them."""
    schema = f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, part int, local bigint"
    numbered = materialize(rows.mapInArrow(_counted(shards), schema))
    totals = numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(F.broadcast(base), ["shard", "part"]).withColumn("slot", F.col("base") + F.col("local"))


def _shard_of(key: Column, alone: list[int], cuts: list[int]) -> Column:
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (key >= F.lit(cut)).cast("int")
    for i in reversed(range(len(alone))):
        shard = F.when(key == F.lit(alone[i]), F.lit(i)).otherwise(shard)
    return shard.cast("int")


def balanced_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (NULL)."""
    rows = materialize(sized_rows(documents))
    alone = [key for key, _ in oversize_groups(rows, shards)]
    rest = rows.where(~F.col("order_key").isin(alone)) if alone else rows
    cuts, _ = minimax_cuts(rest, shards - len(alone))
    placed = rows.withColumn("shard", _shard_of(F.col("order_key"), alone, cuts))
    return slots(placed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
