"""Near duplicates: documents whose sets of five-word shingles have a Jaccard similarity of 0.75.

One hash function orders the shingles. A set's sketch is its SKETCH smallest hashes, and inverted
lists of these retained values say which sets overlap. Sets are handled once however many documents
have them ("nodes"). The steps:

1. One pass over the texts gives per document the size, digest and sketch of its set.
2. Values retained by a single node are dropped. Lists of up to HOT nodes are used as they are. For
   longer ones (passages that many documents share, large groups of near copies) only nodes count
   that can need them: a pair without a common value in a short list has all its common retained
   values in long ones, and it has at least `least_shared` of them. For these nodes the lists are
   made anew from full sets, rarest values first: two sets of the threshold share one of the first
   n / 4 + 1 values of each, and the place of their first common value bounds what they can share
   (prefix and positional filter). What nobody else has comes first and uses the prefix up, so a
   text that only resembles a large group is soon out.
3. Every list is first linked to one node only, a star around its least peculiar one. Pairs are
   estimated on the sketch of the union (the smallest SKETCH values of both) and those not clearly
   below the threshold are counted exactly on full sets, made again from the texts concerned.
4. Inside a list, pairs within one component need no further look, as only components are asked
   for. Pairs across components of a list are tested in a second round: members outside the list's
   largest component against all others. Nothing is capped or left out in either round; a group of
   n near copies costs about n pairs instead of n * n / 2.

Two sets that reach the threshold miss each other only if fewer than `least_shared` of the union's
64 smallest values are common where three quarters are expected (5.8 standard deviations), or if the
estimate is off by as much; sets of up to SKETCH shingles never do.

Defined results: a text without words, or NULL, has an empty set, links to nothing and is its own
component. Rows with one doc_id are one document only where their sets are equal. A row without
doc_id takes no part: component_id is NULL and it is kept. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens.llm import workers
from flowlens.llm.components import connected_components
from flowlens.llm.tables import materialize, rows_that_stay, texts
from flowlens.llm.word_cache import sliced, slices

WORDS = 5
PERCENT = 75
SKETCH = 64
HOT = 32  # nodes of a list that is used whole
SLACK = 6.0  # standard deviations an estimate may fall short by
MEMBER_BITS = 1 << 24  # fixed size of the filter that says whose sets are made again


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles: words between ASCII white space
    with A-Z lower-cased, five in a row, or all of them if there are fewer."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    ends = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    empty = np.asarray(pc.equal(flat, ""))
    coded = flat.filter(pa.array(~empty)).dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(~empty)])[ends - ends[0]]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.empty(0, np.uint64)
    rows = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rows = _mixed(rows ^ words[j : len(words) - WORDS + 1 + j]) if len(rows) else rows
    found = []
    for start, end in zip(ends[:-1], ends[1:]):
        if end - start >= WORDS:
            found.append(np.unique(rows[start : end - WORDS + 1]))
        elif end > start:
            h = np.full(1, end - start, np.uint64)
            for w in words[start:end]:
                h = _mixed(h ^ w)
            found.append(h)
        else:
            found.append(np.empty(0, np.uint64))
    return found


def _digest(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def _signed(values: np.ndarray) -> np.ndarray:
    """The same bits as signed integers, with the order kept."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate([_signed(s) for s in sets]) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()), _lists([s[:size] for s in sets]),
                ],
                ["doc_id", "n_shingles", "set_digest", "sketch"],
            )

    return workers.lean(run)


def sketches(documents: DataFrame, size: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, set_digest, sketch) per document."""
    schema = "doc_id bigint, n_shingles bigint, set_digest binary, sketch array<bigint>"
    return texts(documents).mapInArrow(_sketched(size), schema)


def least_shared(n: Column, size: int) -> Column:
    """How many retained values a set of n shingles shares at least with one it is linked to."""
    # A linked set has n / 0.75 shingles at most, a quarter of which may be foreign: so many of its
    # retained values can be missing here. Above `size` the binomial bound takes over.
    sure = F.least(F.ceil(n * PERCENT / 100), F.ceil(size - n / 3))
    likely = max(1, math.floor(size * PERCENT / 100 - SLACK * math.sqrt(size * 0.75 * 0.25)))
    return F.when(n <= size, sure).otherwise(F.greatest(F.lit(likely), sure)).cast("int")


def _may_link(n_a: str, place_a: str, n_b: str, place_b: str) -> Column:
    """Sizes, and the places of a first common value, leave the threshold in reach."""
    most = F.least(F.col(n_a) - F.col(place_a), F.col(n_b) - F.col(place_b))
    return most * (100 + PERCENT) >= (F.col(n_a) + F.col(n_b)) * PERCENT


def inverted_lists(documents: DataFrame, nodes: DataFrame, size: int = SKETCH, hot: int = HOT) -> DataFrame:
    """(long, value, node, n, own, place) as far as a value can show a pair: see step 2 above. `place`
    is that of the value in its set, `own` the number of values the set shares with nobody; both are
    0 in short lists, which are not ordered."""
    entries = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    entries = materialize(entries.join(shared, "value"))
    none = F.lit(0).alias
    short = entries.where(F.col("df") <= hot).select(F.lit(False).alias("long"), "value", "node", "n", none("own"), none("place"))
    held = entries.where(F.col("df") > hot).groupBy("node", "n").agg(F.count(F.lit(1)).alias("held"))
    members = held.where(F.col("held") >= least_shared(F.col("n"), size)).select("node")
    return short.unionByName(_long_lists(full_sets(documents, nodes.join(members, "node", "left_semi"))))


def _long_lists(sets: DataFrame) -> DataFrame:
    """Lists over full sets, each set in those of its first n / 4 + 1 values, the rarest first. What
    is gathered for a set is part of its own shingles."""
    values = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = values.join(shared, "value").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared")
    )
    own = F.col("n") - F.size("shared")
    first = F.floor(F.col("n") * (100 - PERCENT) / 100).cast("int") + 1 - own
    placed = ordered.where(first > 0).select("node", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), first)))
    return placed.select(
        F.lit(True).alias("long"), "col.value", "node", F.col("n").cast("bigint").alias("n"), "own", (F.col("own") + F.col("pos")).alias("place")
    )


def _estimated(size: int):
    """Keeps pairs whose similarity, estimated on the union's sketch, is not clearly too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            one, two = batch.column("sketch_a"), batch.column("sketch_b")
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            for i, (n_a, n_b) in enumerate(sizes):
                a, b = one[i].values.to_numpy(), two[i].values.to_numpy()
                union = np.union1d(a, b)
                whole = n_a <= size and n_b <= size
                union = union if whole else union[:size]
                common = np.intersect1d(a, b, assume_unique=True)
                common = int(np.searchsorted(common, union[-1], "right"))
                slack = 0.0 if whole else SLACK * math.sqrt(0.75 * 0.25 * len(union))
                keep[i] = common * 100 >= PERCENT * len(union) - 100 * slack
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return workers.lean(run)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        one, two = batch.column("set_a"), batch.column("set_b")
        for i in range(batch.num_rows):
            a, b = one[i].values.to_numpy(), two[i].values.to_numpy()
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = 100 * common >= PERCENT * (len(a) + len(b) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the given columns of both of their nodes."""
    for side in ("a", "b"):
        own = table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c.removesuffix('_shingles')}_{side}") for c in columns))
        pairs = pairs.join(own, side)
    return pairs


def linked(documents: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold. Full sets are made only for nodes of pairs that
    the estimate leaves."""
    likely = materialize(_sides(pairs, nodes, "n_shingles", "sketch").mapInArrow(_estimated(size), "a bigint, b bigint"))
    concerned = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = full_sets(documents, nodes.select("node", "set_digest", "doc_id").join(concerned, "node"))
    return materialize(_sides(likely, sets, "set").mapInArrow(workers.lean(_confirmed), "a bigint, b bigint"))


def _member_slots(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(MEMBER_BITS))


def _made_again(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            inside = (members[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            few = batch.filter(pa.array(inside.astype(bool)))
            for part in slices(few, "text") if few.num_rows else ():
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)], ["set_digest", "set"]
                )

    return workers.lean(run)


def full_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of the given nodes. A filter of fixed size over their documents' ids lets the
    pass over the texts leave out nearly all others; texts are not shuffled."""
    rows, nodes = texts(documents), materialize(nodes)
    slots = nodes.select(_member_slots(F.col("doc_id")).alias("s"))
    bits = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits")
    ).collect()  # no more than MEMBER_BITS / 32 rows
    words = np.zeros(MEMBER_BITS // 32, np.uint32)
    for r in bits:
        words[r["w"]] = r["bits"]
    held = documents.sparkSession.sparkContext.broadcast(words.astype("<u4").tobytes())
    made = rows.where(F.col("doc_id").isNotNull()).select("text", _member_slots(F.col("doc_id")).alias("slot")).mapInArrow(
        _made_again(held), "set_digest binary, set array<bigint>"
    )
    # documents that share a slot with a member bring sets of other nodes, or the same set again
    once = made.groupBy("set_digest").agg(F.first("set").alias("set"))
    return materialize(nodes.select("node", "set_digest").join(once, "set_digest").select("node", "set"))


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    found = connected_components(links)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def node_components(documents: DataFrame, nodes: DataFrame, size: int, hot: int) -> DataFrame:
    """(node, component) of every node that some list still holds."""
    key = ["long", "value"]
    lists = materialize(inverted_lists(documents, nodes, size, hot))
    heads = lists.groupBy(*key).agg(F.min(F.struct("own", "node", "n", "place")).alias("h"), F.count(F.lit(1)).alias("df"))
    heads = materialize(
        heads.where("df > 1").select(*key, F.col("h.node").alias("head"), F.col("h.n").alias("n_head"), F.col("h.place").alias("place_head"))
    )
    lists = lists.join(heads, key)
    star = lists.where((F.col("node") != F.col("head")) & _may_link("n", "place", "n_head", "place_head"))
    star = star.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    listed = nodes.join(lists.select("node").distinct(), "node", "left_semi")
    first = linked(documents, star, nodes, size)

    told = materialize(lists.drop("n_head", "place_head").join(_components(first, listed), "node"))
    sizes = told.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component")).getField("component").alias("main")
    )
    open_ = told.join(main.where("parts > 1").drop("parts"), key)

    def side(name: str, *others: str) -> DataFrame:
        own = {"node": name, "n": f"n_{name}", "place": f"place_{name}", "component": f"of_{name}"}
        return open_.select(*key, *(F.col(old).alias(new) for old, new in own.items()), *others)

    outside = side("a", "head", "main").where("of_a <> main").drop("main")
    across = outside.join(side("b", "main"), key).where(
        (F.col("of_a") != F.col("of_b"))
        & ((F.col("of_b") == F.col("main")) | (F.col("a") < F.col("b")))
        & (F.col("a") != F.col("head")) & (F.col("b") != F.col("head"))
        & _may_link("n_a", "place_a", "n_b", "place_b")
    )
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = linked(documents, across, nodes, size)
    return _components(first.unionByName(second), listed)


def _judged(documents: DataFrame, size: int, hot: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, set_digest."""
    rows = materialize(sketches(documents, size).withColumn("row", F.monotonically_increasing_id()))
    known = rows.where(F.col("doc_id").isNotNull() & F.col("set_digest").isNotNull())
    # One row stands for all documents with its set: the one with the smallest id.
    sets = known.groupBy("set_digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"))
    sets = materialize(sets)
    nodes = materialize(
        rows.select(F.col("row").alias("node"), "n_shingles", "sketch").join(sets, "node")
    )
    found = materialize(node_components(documents, nodes, size, hot))
    named = sets.join(found, "node", "left").select(
        "set_digest", "doc_id", F.coalesce("component", "node").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(smallest, "component").select("set_digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_digest").join(by_set, "set_digest", "left")
    # rows with an empty set, and an id, stand for themselves
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "set_digest",
    )


def near_groups(documents: DataFrame, size: int = SKETCH, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _judged(documents, size, hot).drop("set_digest")


def _with_digests(column: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            found = pa.array([_digest(s) for s in shingle_sets(batch.column(column))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return workers.lean(run)


def drop_near_copies(documents: DataFrame, size: int = SKETCH, hot: int = HOT) -> DataFrame:
    """The documents that stay, with their columns: of each component those with its smallest id.
    Of an id with several texts only the rows go whose set of shingles has a smaller id in its
    component. Rows without words, and rows without doc_id, stay."""

    def digested(rows: DataFrame, name: str) -> DataFrame:
        column = [c.lower() for c in rows.columns].index("text")
        schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
        return rows.mapInArrow(_with_digests(column, name), schema)

    decided = _judged(documents, size, hot).select("doc_id", F.col("set_digest").alias("digest"), "kept")
    return rows_that_stay(documents, decided, digested)
