"""Importance resampling towards a target corpus, with weights from bit-sliced counts.

A pass over the texts hashes the features of each document to buckets and writes the buckets (two
bytes a feature) to the shared folder; totals per bucket are summed on the map side. The gain of a
bucket, how much likelier it is in the target, is a signed integer; all gains are cut into bitplanes
of one bit per bucket, those of positive and of negative gains apart.

The second pass reads the buckets only. A document's counts per bucket become planes as well: bit b
of plane j is bit j of the count of bucket b. A gain plane i AND a count plane j have as many bits in
common as there are products of 2^(i+j) in the weight, so the sum of popcounts times powers of two
is the exact weight, in integers. Documents go through in groups of bounded size; a document has as
many planes as its largest count has bits.

Scores get a Gumbel variable from a hash of the id, so that the highest scores are a draw without
replacement. Ranks come from a range partitioning by score and id: place within the partition plus
the rows of the partitions before it. No partition holds more than its range, nothing is collected.

Defined results: a NULL text has no features and weight 0. Repeated rows are drawn separately, in
any order among each other. A row without doc_id has no score, doesn't count for N and is not drawn.
An empty target or corpus counts 0 in every bucket. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.tables import materialize, texts
from flowlens.llm.word_cache import slices

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10  # of the documents with enough words that are drawn
GROUP = 256  # documents whose planes are made at once, at most
SLICE_BYTES = 1 << 20  # of buckets of such a group, a single longer document aside

_BYTES = (BUCKETS + 63) // 64 * 8  # of a plane, in whole words of 64 bits


def _word_bytes() -> np.ndarray:
    """What becomes of each byte of UTF-8: A-Z in lower case, separators a space. Bytes of other
    characters than ASCII belong to words."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[low : high + 1] = 32
    return table


_TABLE = _word_bytes()


def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, end of each text's words)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(ends - ends[0]), pa.py_buffer(_TABLE[raw]))
    lists = pc.ascii_split_whitespace(plain)
    starts = np.asarray(lists.offsets, np.int64)
    flat = lists.flatten()
    full = np.asarray(pc.not_equal(flat, ""))
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[starts - starts[0]][1:]


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, end of each text's features)."""
    words, ends = word_lists(column)
    coded = words.dictionary_encode()
    distinct = (zlib.crc32(w) % BUCKETS for w in coded.dictionary.cast(pa.large_binary()).to_pylist())
    hashed = np.fromiter(distinct, np.uint16, len(coded.dictionary))
    return hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(hashed) else np.empty(0, np.uint16), ends


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "text")):
        found, ends = buckets_of(batch.column("text"))
        offsets = pa.py_buffer((np.concatenate([[0], ends]) * 2).astype("<i4").tobytes())
        raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(found.astype("<u2").tobytes())])
        n = pa.array(np.diff(ends, prepend=0))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, raw], ["doc_id", "n_features", "buckets"])


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, n_features, buckets): a document's buckets as integers of two bytes, in order."""
    return texts(documents).mapInArrow(_hashed, "doc_id bigint, n_features bigint, buckets binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for raw in batch.column("buckets"):
            total += np.bincount(np.frombuffer(raw.as_buffer(), "<u2"), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def bucket_totals(rows: DataFrame) -> np.ndarray:
    """Features per bucket over all rows: at most BUCKETS numbers reach the driver."""
    parts = rows.select("buckets").mapInArrow(_summed, "bucket int, n bigint")
    total = np.zeros(BUCKETS, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus), per bucket."""
    s, t = int(corpus.sum()), int(target.sum())
    shares = (
        (float(b) + 1.0) * (float(s) + BUCKETS) / ((float(a) + 1.0) * (float(t) + BUCKETS))
        for a, b in zip(corpus.tolist(), target.tolist())
    )
    return np.fromiter((math.floor(1000 * math.log(x)) for x in shares), np.int64, BUCKETS)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bitplanes of non-negative integers per bucket, the lowest first, as 64-bit words."""
    height = int(values.max(initial=0)).bit_length()
    bits = np.zeros((height, _BYTES * 8), np.uint8)
    bits[:, : len(values)] = (values[None, :] >> np.arange(height)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def weights(found: np.ndarray, ends: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Sum of the gains of each document's features, by the planes of positive and negative gains."""
    out = np.zeros(len(ends), np.int64)
    which = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    key, count = np.unique(which * (_BYTES * 8) + found, return_counts=True)
    for j in range(int(count.max(initial=0)).bit_length()):
        mine = key[(count >> j) & 1 == 1]
        docs, row = np.unique(mine // (_BYTES * 8), return_inverse=True)
        bit = row * (_BYTES * 8) + mine % (_BYTES * 8)
        # no bit comes twice, so sums of a byte's bits are the byte
        byte = np.bincount(bit >> 3, weights=1 << (bit & 7), minlength=len(docs) * _BYTES)
        plane = byte.astype(np.uint8).view(np.uint64).reshape(len(docs), _BYTES // 8)
        for sign, gain in ((1, plus), (-1, minus)):
            for i, bits in enumerate(gain):
                common = np.bitwise_count(plane & bits).sum(1, dtype=np.int64)
                out[docs] += sign * (common << (i + j))
    return out


def _weighed(plus: np.ndarray, minus: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (s for b in batches for s in slices(b, "buckets", SLICE_BYTES)):
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                raw = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("buckets")]
                ends = np.cumsum([len(x) for x in raw])
                found = weights(np.concatenate(raw).astype(np.int64), ends, plus, minus)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_features"), pa.array(found)], ["doc_id", "n_features", "weight"]
                )

    return run


def _gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variable) from the first 32 bits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame) -> DataFrame:
    """The rows with `place`: from 1 in order of score, highest first, and id."""
    dealt = rows.repartitionByRange(F.desc("score"), F.asc("doc_id")).sortWithinPartitions(F.desc("score"), F.asc("doc_id"))
    # the number's upper bits are the partition, the lower 33 the place within it
    dealt = materialize(dealt.select("*", F.monotonically_increasing_id().alias("number")))
    part, inside = F.shiftright("number", 33), F.col("number").bitwiseAND((1 << 33) - 1)
    totals = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    base = totals.select("part", (running - F.col("n")).alias("base"))  # a row per partition of the shuffle
    placed = dealt.withColumn("part", part).withColumn("inside", inside).join(F.broadcast(base), "part")
    return placed.withColumn("place", F.col("base") + F.col("inside") + 1).drop("part", "inside", "number", "base")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (NULL if not drawn). `target`
    has a column `text`."""
    rows = materialize(features(documents))
    aim = features(target.select(F.lit(0).alias("doc_id"), target["text"].alias("text")))
    gain = gains(bucket_totals(rows), bucket_totals(aim))
    plus, minus = _planes(np.maximum(gain, 0)), _planes(np.maximum(-gain, 0))
    weighed = rows.mapInArrow(_weighed(plus, minus), "doc_id bigint, n_features bigint, weight bigint")
    scored = materialize(weighed.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed)))
    takes_part = (F.col("n_features") >= least_words) & F.col("doc_id").isNotNull()
    ranked = _ranked(scored.where(takes_part))
    drawn = scored.where(takes_part).count() * percent // 100
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    out = ranked.withColumn("rank", rank).drop("place")
    return out.unionByName(scored.where(~takes_part).withColumn("rank", F.lit(None).cast("bigint")))
