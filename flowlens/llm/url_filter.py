"""Verdicts on urls by host and path rules, looked up in cascades of Bloom filters.

The listed keys are the rules ('example.org/es/'). A url asks for one key per shape of rule, a
shape being a number of host labels and a number of path characters. The first filter of a cascade
holds the listed keys; the second those keys of the corpus that the first one passes although they
are not listed; the third the listed keys that the second one passes, and so on until a filter
passes nothing wrong. Over the keys of the corpus the answer is then exact, and it is read off the
filters alone: they are constants of the expression, so pages are neither shuffled nor joined.

A filter is one binary constant, and the tests of a key are functions of an array's elements. The
expression hence has the same size for five rules and for many thousand of many shapes.

The first filter's error rate is chosen so that about as many wrong keys pass as there are listed
ones; after that half are let through. A cascade hence takes some bits per listed key times the
logarithm of (keys of the corpus / listed keys): it grows with the list, hardly with the corpus.

Defined results: a url that is NULL or has no '://' has an empty host and path; no rule fits it. A
page that no rule fits is allowed. Repeated rows and rows without page_id are judged like others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import materialize

MAX_FILTER_BITS = 1 << 25  # 4.8 MB of constant: a larger list is refused rather than sent to every task
BYTE_BITS = 7  # used of every byte, so that each is an ASCII character
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first '://', the host with A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Shape:
    """What all rules of one form have in common: labels of the host, characters of the path."""

    labels: int
    path_chars: int

    @staticmethod
    def of(rule: str) -> "Shape":
        host, _, _ = rule.partition("/")
        return Shape(host.count(".") + 1, len(rule) - len(host))


def keys_of(shapes: list[Shape], host: Column, path: Column) -> Column:
    """The url's key of every shape that it has: hosts with fewer labels and shorter paths have none."""
    forms = F.array(*(F.struct(F.lit(s.labels).alias("labels"), F.lit(s.path_chars).alias("chars")) for s in shapes))
    fitting = F.filter(forms, lambda s: (s["chars"] <= F.length(path)) & (s["labels"] <= F.size(F.split(host, r"\."))))
    keys = F.transform(
        fitting,
        lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, 1, s["chars"])),
    )
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


@dataclass
class Bloom:
    """A Bloom filter as bytes, asked by an expression."""

    bits: int
    hashes: int
    salt: int
    held: bytes = b""

    def place(self, key: Column, i: Column) -> Column:
        """The i-th place of a key."""
        # 31-bit halves: products of them stay within a bigint
        h = F.xxhash64(key, F.lit(self.salt))
        a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
        return F.pmod(a + i * b, F.lit(self.bits))

    def numbers(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.hashes - 1))

    def passes(self, key: Column) -> Column:
        held = F.lit(self.held)

        def is_set(i: Column) -> Column:
            p = self.place(key, i)
            at = F.floor(p / BYTE_BITS).cast("int")
            byte = F.ascii(F.substring(held, at + 1, F.lit(1)).cast("string"))
            return F.call_function("shiftright", byte, (p % BYTE_BITS).cast("int")).bitwiseAND(F.lit(1)) == 1

        return F.forall(self.numbers(), is_set)  # ends at the first place that isn't

    def built_from(self, keys: DataFrame) -> "Bloom":
        """Fills the filter: one map-side aggregation of bits into words, no more rows than words."""
        places = F.transform(self.numbers(), lambda i: self.place(F.col("key"), i))
        at = keys.select(F.explode(places).alias("p"))
        word = BYTE_BITS * 8  # bits in a row that comes to the driver
        found = at.groupBy(F.floor(F.col("p") / word).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(p % {word} as int))")).alias("bits"))
        held = bytearray(math.ceil(self.bits / word) * 8)
        for w, bits in found.collect():
            held[w * 8 : w * 8 + 8] = bytes(bits >> BYTE_BITS * i & 0x7F for i in range(8))
        self.held = bytes(held)
        return self


def _bloom(keys: int, rate: float, salt: int) -> Bloom:
    bits = max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2))
    if bits > MAX_FILTER_BITS:
        raise ValueError(f"a filter of {bits} bits is over the bound of {MAX_FILTER_BITS}")
    return Bloom(bits, min(30, max(1, round(bits / keys * math.log(2)))), salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def contains(self, key: Column) -> Column:
        """Whether the first filter that a key fails stands at an even place (from one)."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            inside = F.when(~self.levels[depth].passes(key), F.lit(depth % 2 == 1)).otherwise(inside)
        return F.coalesce(inside & key.isNotNull(), F.lit(False))


def build_cascade(listed: DataFrame, universe: DataFrame, universe_rows: int) -> Cascade:
    """A cascade that is exact on every key of `universe`, both with one column `key`.

    Only the first level looks at the universe. What passes it is about as large as the list; the
    levels after it are built from those few keys, told apart from listed ones by a grouping.
    """
    listed = materialize(listed.where(F.col("key").isNotNull()).distinct())
    n = listed.count()
    if n == 0:
        return Cascade(())
    levels = [_bloom(n, min(0.5, n * math.sqrt(0.5) / max(1, universe_rows)), 1).built_from(listed)]
    passed = universe.where(F.col("key").isNotNull() & levels[0].passes(F.col("key")))
    told = (
        passed.distinct().select("key", F.lit(False).alias("listed"))
        .unionByName(listed.select("key", F.lit(True).alias("listed")))
        .groupBy("key").agg(F.max("listed").alias("listed"))
    )
    told = materialize(told)
    inside, outside = told.where("listed").select("key"), told.where("not listed").select("key")
    wrong = outside  # keys that the level before passes wrongly
    while (count := wrong.count()) > 0:
        level = _bloom(count, 0.5, len(levels) + 1).built_from(wrong)
        levels.append(level)
        other = inside if len(levels) % 2 == 0 else outside
        # only keys that passed every level before this one can be passed wrongly by it
        for earlier in levels:
            other = other.where(earlier.passes(F.col("key")))
        wrong = materialize(other)
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules: dict[str, str] | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. The longest fitting rule wins."""
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    host, path = split_url(pages["url"].cast("string"))
    urls = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    rows = pages.count()
    fitting = []
    for verdict in sorted(set(rules.values())):
        mine = [r for r, v in rules.items() if v == verdict]
        shapes = sorted({Shape.of(r) for r in mine}, key=lambda s: (s.labels, s.path_chars))
        keys = keys_of(shapes, F.col("host"), F.col("path"))
        listed = spark.createDataFrame([(r,) for r in mine], "key string")
        cascade = build_cascade(listed, urls.select(F.explode(keys).alias("key")), rows * len(shapes))
        named = F.transform(
            F.filter(keys, cascade.contains),
            lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict")),
        )
        # The longest fitting rule is the greatest (length, key); a key is in at most one list.
        fitting.append(F.array_max(named))
    nothing = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    best = F.greatest(nothing, nothing, *fitting)
    judged = urls.select("*", best.alias("best"))
    return judged.select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
