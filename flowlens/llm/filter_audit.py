"""Audit of five quality filters in every order: what each removes, and what that costs.

Every filter has an id table in the shared folder: the rows that fail it, with their part, and once
more as `good` or `toxic` if a left-semi join finds a label for them. A filter that comes after
others removes those rows of its table that left-anti joins with the tables before it leave. What is
gone after a set of filters doesn't depend on their order within the set, so a set is counted once:
the rows of its last letter without those of the letters before it, plus what the rest of the set
removes. Thirty-one chains of anti joins over five tables thus give the survivors of all prefixes of
all 120 orders. CHAINS of them run at a time and share their exchanges: one plan of all would take
the driver more memory, with every stage of it, than all tables together. Removals are differences
of survivors, redundancies are failures less removals. Texts are read once.

A text that equals one with a smaller id fails the last filter. Texts are compared by SHA-256, whose
smallest ids come from a map-side aggregation. Digests with more than 1 / HOT_SHARE of the rows,
fewer than HOT_SHARE in number, are broadcast; the others meet their rows by an ordinary shuffle.

Defined results: a NULL text counts as empty, a NULL lang as the empty string. Repeated rows count
each; rows with the same id are not copies of each other, however often that id comes. A row
without doc_id has no label and never fails E. Of several labels of a document any one counts. An
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import materialize

FILTERS = "ABCDE"
HOT_SHARE = 1000  # a digest with a larger part of the rows than this is handled by broadcast
CHAINS = 4  # chains of anti joins in one plan
WHITE = r"[\x20\x09-\x0D]+"
KINDS = ("all", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The conditions of A to D on a text that isn't NULL."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _signals(documents: DataFrame) -> DataFrame:
    """(row, doc_id, part, digest, A, B, C, D): one pass over the texts, with a number per row."""
    rows = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(documents["lang"].cast("string"), F.lit("")).alias("part"),
        F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"),
    )
    checks = [condition.alias(name) for name, condition in failures(F.col("text")).items()]
    return materialize(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "part",
            F.unhex(F.sha2("text", 256)).alias("digest"), *checks,
        )
    )


def copies(signals: DataFrame) -> DataFrame:
    """(row, doc_id, part) of the rows whose digest a smaller id has too."""
    groups = signals.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    groups = materialize(groups.where("first < last"))
    total = signals.count()
    hot = groups.where(F.col("n") * HOT_SHARE > total).select("digest", "first")
    cold = groups.where(F.col("n") * HOT_SHARE <= total).select("digest", "first")
    rows = signals.select("row", "doc_id", "part", "digest")
    known = F.broadcast(hot.select("digest"))  # fewer than HOT_SHARE rows, whatever the input
    found = rows.join(F.broadcast(hot), "digest").unionByName(
        rows.join(known, "digest", "left_anti").join(cold, "digest")
    )
    return found.where("doc_id > first").select("row", "doc_id", "part")


def failing_ids(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(documents per part; per filter the stored table row, part, kind of what fails it)."""
    signals = _signals(documents)
    totals = materialize(signals.groupBy("part").agg(F.count("*").alias("n")))
    marked = labels.select(
        labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic")
    )
    label_ids = {
        "good": marked.where("quality = 1").select("doc_id").distinct(),
        "toxic": marked.where("toxic = 1").select("doc_id").distinct(),
    }
    tables = {}
    for name in FILTERS:
        failing = materialize(copies(signals)) if name == "E" else signals.where(name).select("row", "doc_id", "part")
        every = failing.select("row", "part", F.lit("all").alias("kind"))
        labelled = [
            failing.join(ids, "doc_id", "left_semi").select("row", "part", F.lit(kind).alias("kind"))
            for kind, ids in label_ids.items()
        ]
        tables[name] = materialize(reduce(DataFrame.unionByName, labelled, every))
    return totals, tables


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _removed_last(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, kind, last, before, n): rows that the filter `last` removes after the set `before` of
    filters with smaller letters, for every such pair."""
    counted = []
    for at, name in enumerate(FILTERS):
        counts = []
        for before in range(1 << at):
            left = tables[name]
            for other in FILTERS[:at]:
                if before & _bit(other):
                    left = left.join(tables[other].select("row"), "row", "left_anti")
            counts.append(
                left.groupBy("part", "kind").agg(F.count("*").alias("n")).select(
                    "part", "kind", F.lit(at).alias("last"), F.lit(before).alias("before"), "n"
                )
            )
        counted += [materialize(reduce(DataFrame.unionByName, counts[i : i + CHAINS])) for i in range(0, len(counts), CHAINS)]
    return reduce(DataFrame.unionByName, counted)


def _gone(removed: DataFrame) -> DataFrame:
    """(part, gone): for every set of filters, as bits, and kind what the set removes, the sum over
    its letters of what each removes last. No more than 96 entries per part."""
    sets = F.filter(
        F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)),
        lambda m: (F.expr("shiftleft(1, last)").bitwiseAND(m) != 0)
        & (m.bitwiseAND(F.expr("shiftleft(1, last) - 1")) == F.col("before")),
    )
    summed = removed.select("part", "kind", F.explode(sets).alias("mask"), "n").groupBy("part", "kind", "mask").agg(F.sum("n").alias("n"))
    entries = F.collect_list(F.struct(F.struct("kind", "mask"), "n"))
    return summed.groupBy("part").agg(F.map_from_entries(entries).alias("gone"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley."""
    totals, tables = failing_ids(documents, labels)
    removed = _removed_last(tables)
    gone = totals.join(_gone(removed), "part", "left")  # a row per part from here on

    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = gone.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    own = F.col("filter_order").substr(F.col("step"), F.lit(1))

    def mask(upto: Column) -> Column:
        inside = (F.when(F.instr("filter_order", x) <= upto, _bit(x)).otherwise(0) for x in FILTERS)
        return reduce(lambda x, y: x + y, inside)

    def at(kind: str, which: Column) -> Column:
        found = F.try_element_at("gone", F.struct(F.lit(kind).alias("kind"), which.cast("int").alias("mask")))
        return F.coalesce(found, F.lit(0).cast("bigint"))

    full = (1 << len(FILTERS)) - 1
    single = reduce(lambda x, y: x + y, (F.when(own == x, _bit(x)).otherwise(0) for x in FILTERS))
    steps = steps.withColumns({"before": mask(F.col("step") - 1), "after": mask(F.col("step")), "single": single})
    lost = {kind: at(kind, F.col("after")) - at(kind, F.col("before")) for kind in KINDS}
    counted = steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "single",
        (F.col("n") - at("all", F.col("after"))).alias("kept"),
        lost["all"].alias("removed"),
        (at("all", F.col("single")) - lost["all"]).alias("redundant"),
        (at("all", F.lit(full)) - at("all", F.lit(full) - F.col("single"))).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
    )
    # 120 rows per part and filter, a fixed number
    shares = counted.groupBy("part", "single").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "single"]).drop("single")
