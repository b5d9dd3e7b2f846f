"""Toxicity from class-conditional Kneser-Ney models of words spelled out.

Two models, one of toxic and one of ordinary rows, give every word a likelihood letter by letter.
Contexts are up to ORDER - 1 letters of the word, with a mark for its beginning. The long contexts
count per class; they back off with absolute discounting to short ones whose continuation counts
(in how many longer contexts a letter appears) are shared by both classes. What neither class has
seen often is thus spelled alike by both and says nothing, while a stem that only toxic rows have
raises the toxic likelihood in every inflection.

A word's evidence is the difference of its log-likelihoods per letter. A text is judged by its
strongest passage of WINDOW words and by the whole text, both as means, so that long texts are not
worse for their length; a logistic curve over the two, fitted on rows that the counts it is fitted
with have not seen, gives the score.

All labelled rows outside the held-out fold are counted; only the rows that the curve is fitted on are
a bounded sample. Every n-gram is its own key, its code points packed into two numbers, so that no two
n-grams share a count. Words are counted first, then the n-grams of the distinct words. The context
and the shorter forms of an n-gram down to three letters contain the same two letters before its last,
so that one exchange by these brings together all that its likelihood is made of. The result is one
table of ORDER-grams with their evidence: up to LOCAL_GRAMS of them are sent to the workers, which look
words up, and beyond that n-grams meet words and words meet texts by joins.

Defined results: texts that are NULL, empty or without letters and digits get the score of no
evidence. Without any label, or with one class only, every score is the share of toxic labels (0
without labels). Labels that are NULL or of unknown documents teach nothing; of several labels of
one document the greatest counts. Rows without an id are not held out and teach nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.tables import fold_of, materialize, texts
from flowlens.llm.word_cache import slices

TRAIN_ROWS = 250_000  # that the curve is fitted on
ORDER = 6  # letters of an n-gram
SHARED = 3  # n-grams of this length and less have shared counts
DISCOUNT = 0.75
WINDOW = 4  # words
MAX_LETTERS = 64  # of a piece of a word; a longer word is several pieces
CACHE_WORDS = 400_000
LOCAL_LABELS = 1_000_000  # labels that are broadcast
LOCAL_GRAMS = 8_000_000  # ORDER-grams that are sent to the workers
BITS = 21  # of a code point
MODELS = ("half", "full")


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, each behind ORDER - 1 marks and with one mark
    at its end, and the place of each point in its word (marks in front are negative)."""
    pad = "\x00" * (ORDER - 1)
    joined = "".join(f"{pad}{w}\x01" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    return points, np.arange(len(points)) - np.repeat(starts, sizes) - (ORDER - 1)


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER points up to every letter and end of the words, as two numbers of three points each,
    and the word each belongs to."""
    pieces = [(p, i) for i, w in enumerate(words) for p in _cut(w)]
    points, place = _spelled([p for p, _ in pieces])
    points, at = points.astype(np.int64), np.flatnonzero(place >= 0)
    three = [(points[at - k - 2] << 2 * BITS) | (points[at - k - 1] << BITS) | points[at - k] for k in (3, 0)]
    return three[0], three[1], np.repeat([i for _, i in pieces], [len(p) + 1 for p, _ in pieces]).astype(np.int64)


def _words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case runs of letters and digits of a batch of texts, which of them each
    occurrence is, and where each text's occurrences end."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    runs = pc.ascii_split_whitespace(pc.utf8_trim(pc.replace_substring_regex(lowered, r"[^\p{L}\p{N}]+", " "), " "))
    ends = np.asarray(runs.offsets, dtype=np.int64)
    flat = runs.flatten()
    empty = pc.equal(flat, "")
    counts = np.concatenate([[0], np.cumsum(~np.asarray(empty))])
    coded = flat.filter(pc.invert(empty)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts[ends[1:] - ends[0]]


def _cut(word: str) -> list[str]:
    return [word[i : i + MAX_LETTERS] for i in range(0, len(word), MAX_LETTERS)]


CELLS = ("ordinary_half", "toxic_half", "ordinary_rest", "toxic_rest")
COUNTS = ", ".join(f"{c} bigint" for c in CELLS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of slices of texts, and how often they stand in rows of each cell; none for cell -1."""
    for batch in (s for b in batches for s in slices(b, "text")):
        words, which, ends = _words(batch.column("text"))
        cell = np.repeat(batch.column("cell").to_numpy(), np.diff(ends, prepend=0))
        times = {c: np.bincount(which[cell == i], minlength=len(words)) for i, c in enumerate(CELLS)}
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), **times})


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo, owner = _windows(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_pydict({"hi": hi, "lo": lo, **{c: batch.column(c).to_numpy()[owner] for c in CELLS}})


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in CELLS))


def _backed_off(count, total, kinds, lower):
    """The likelihood by absolute discounting, as a column."""
    share = F.greatest(count - DISCOUNT, F.lit(0.0)) / total
    return F.when(total > 0, share + F.least(F.lit(1.0), DISCOUNT * kinds / total) * lower).otherwise(lower)


def _of_two_letters(grams: DataFrame) -> DataFrame:
    """Per three letters (lo) the likelihood of the last one behind the middle one, for both models."""
    seen = {"half": F.col(CELLS[0]) + F.col(CELLS[1]) > 0, "full": sum(F.col(c) for c in CELLS) > 0}
    three = grams.groupBy("lo").agg(*(F.max(seen[m].cast("bigint")).alias(m) for m in MODELS))
    three = three.withColumn("two", F.col("lo").bitwiseAND((1 << 2 * BITS) - 1))
    two = three.groupBy("two").agg(*(F.sum(m).alias(m) for m in MODELS))
    two = materialize(two.withColumn("one", F.col("two").bitwiseAND((1 << BITS) - 1)).withColumn("before", F.shiftright("two", BITS)))
    some = lambda m: (F.col(m) > 0).cast("bigint")
    one = two.groupBy("one").agg(*(F.sum(some(m)).alias(f"one_{m}") for m in MODELS))
    before = two.groupBy("before").agg(
        *(F.sum(m).alias(f"total_{m}") for m in MODELS), *(F.sum(some(m)).alias(f"kinds_{m}") for m in MODELS)
    )
    whole = one.agg(*(f(F.col(f"one_{m}")).alias(f"{k}_{m}") for m in MODELS for k, f in (
        ("total", F.sum), ("kinds", lambda c: F.sum((c > 0).cast("bigint")))))).first()
    likely = []
    for m in MODELS:
        total, kinds = whole[f"total_{m}"] or 0, whole[f"kinds_{m}"] or 0
        first = _backed_off(F.col(f"one_{m}"), F.lit(float(total)), F.lit(kinds), F.lit(1.0 / (kinds + 2)))  # two marks
        likely.append(_backed_off(F.col(m), F.col(f"total_{m}"), F.col(f"kinds_{m}"), first).alias(f"two_{m}"))
    two = two.join(one, "one").join(before, "before").select("two", *likely)
    return three.select("lo", "two").join(two, "two").drop("two")


def _shares(count: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each n-gram in its context, and what is left for shorter ones."""
    total, kinds = np.bincount(context, count)[context], np.bincount(context, count > 0)[context]
    some = np.maximum(total, 1e-9)
    return np.where(total > 0, np.maximum(count - DISCOUNT, 0.0) / some, 0.0), np.where(total > 0, np.minimum(1.0, DISCOUNT * kinds / some), 1.0)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence of all ORDER-grams of a partition, which holds all that have the same two letters
    before the last. Rows with a negative `hi` bring the likelihoods of two letters."""
    table = pa.Table.from_batches(list(batches))
    if table.num_rows == 0:
        return
    hi, lo = table["hi"].to_numpy(), table["lo"].to_numpy()
    short, long = np.flatnonzero(hi < 0), np.flatnonzero(hi >= 0)
    short = short[np.argsort(lo[short])]
    two = short[np.searchsorted(lo[short], lo[long])]
    hi, lo, mask = hi[long], lo[long], (1 << BITS) - 1
    # Codes of the n-gram and of its context in every row, each from those one letter shorter.
    gram, context = {}, {}
    for n, code in ((SHARED, lo), (SHARED, lo >> BITS)):
        (context if gram else gram)[n] = np.unique(code, return_inverse=True)[1]
    for n in range(SHARED + 1, ORDER + 1):
        letter = (hi >> BITS * (n - SHARED - 1)) & mask
        for codes in (gram, context):
            codes[n] = np.unique((codes[n - 1] << BITS) | letter, return_inverse=True)[1]
    first = {n: np.unique(gram[n], return_index=True)[1] for n in gram}
    cells = [table[c].to_numpy()[long].astype(np.float64) for c in CELLS]
    found = {}
    for m in MODELS:
        classes = cells[:2] if m == "half" else [cells[0] + cells[2], cells[1] + cells[3]]
        longer = gram[SHARED + 1]
        present = np.bincount(longer, classes[0] + classes[1]) > 0
        kept = np.bincount(gram[SHARED][first[SHARED + 1]], present)
        share, rest = _shares(kept, context[SHARED][first[SHARED]])
        shared = share[gram[SHARED]] + rest[gram[SHARED]] * table[f"two_{m}"].to_numpy()[two]
        likely = []
        for c in classes:
            likely.append(shared)
            for n in range(SHARED + 1, ORDER + 1):
                share, rest = _shares(np.bincount(gram[n], c), context[n][first[n]])
                likely[-1] = share[gram[n]] + rest[gram[n]] * likely[-1]
        found[m] = (np.log(np.maximum(likely[1], 1e-12)) - np.log(np.maximum(likely[0], 1e-12))).astype(np.float32)
    yield pa.RecordBatch.from_pydict({"hi": hi, "lo": lo, **found})


def evidence(words: DataFrame) -> DataFrame:
    """(hi, lo, half, full): log-likelihood of toxic minus ordinary of the last letter of each
    ORDER-gram of the words (word and CELLS), by the counts of one half and of all labelled rows."""
    grams = materialize(_sums(words.mapInArrow(_count_grams, f"hi bigint, lo bigint, {COUNTS}"), "hi", "lo"))
    nothing = F.lit(None).cast("double")
    rows = grams.select("*", *(nothing.alias(f"two_{m}") for m in MODELS)).unionByName(
        _of_two_letters(grams).select(F.lit(-1).cast("bigint").alias("hi"), "*", *(F.lit(0).cast("bigint").alias(c) for c in CELLS))
    )
    dealt = rows.repartition(F.shiftright("lo", BITS))
    return materialize(dealt.mapInArrow(_evidence, "hi bigint, lo bigint, half float, full float"))


class Evidence:
    """Evidence of words by a table of ORDER-grams that has all of theirs, kept from batch to batch."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, gain: np.ndarray):
        self.hi, self.lo = np.unique(hi), np.unique(lo)
        code = self._code(hi, lo)
        order = np.argsort(code)
        self.code, self.gain = code[order], gain[order]
        self.known: dict[str, float] = {}

    def _code(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.hi, hi) << 32) | np.searchsorted(self.lo, lo)

    def per_word(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [w for w in words if w not in self.known]
        for start in range(0, len(new), 50_000):
            some = new[start : start + 50_000]
            hi, lo, owner = _windows(some)
            gain = self.gain[np.searchsorted(self.code, self._code(hi, lo))]
            self.known.update(zip(some, np.bincount(owner, gain, len(some)).tolist()))
        return np.array([self.known[w] for w in words])


def _features(gain: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text: the greatest mean evidence of WINDOW words in a row, and the mean of all."""
    found = np.zeros((len(ends), 2))
    if not len(gain):
        return found
    n = np.diff(ends, prepend=0)
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    start = np.repeat(ends - n, n)
    here = np.arange(len(gain))
    passage = (sums[here + 1] - sums[np.maximum(start, here + 1 - WINDOW)]) / WINDOW
    some = n > 0
    found[some, 0] = np.maximum.reduceat(passage, (ends - n)[some])
    found[some, 1] = (sums[ends] - sums[ends - n])[some] / n[some]
    return found


@lru_cache(maxsize=1)
def _unpickled(raw: bytes) -> Evidence:
    return pickle.loads(raw)


def _with(batch: pa.RecordBatch, kept: list[str], found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**{k: batch.column(k) for k in kept}, "passage": found[:, 0], "whole": found[:, 1]})


def _looked_up(held, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpickled(held.value)
        for batch in (s for b in batches for s in slices(b, "text")):
            words, which, ends = _words(batch.column("text"))
            gain = table.per_word(words)[which] if words else np.zeros(0)
            yield _with(batch, kept, _features(gain, ends))

    return run


def _listed(kept: list[str]):
    """Distinct words of each text, and which of them each of its words is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            words, which, ends = _words(batch.column("text"))
            names = np.array(words, object)
            own = [np.unique(w, return_inverse=True) for w in np.split(which, ends[:-1])]
            yield pa.RecordBatch.from_pydict(
                {
                    **{k: batch.column(k) for k in kept}, "words": pa.array([names[i].tolist() for i, _ in own], pa.list_(pa.string())),
                    "which": pa.array([w for _, w in own], pa.list_(pa.int32())),
                }
            )

    return run


def _joined(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for which, gains in zip(batch.column("which"), batch.column("gains")):
                which = np.array(which.as_py(), np.int64)
                gain = np.zeros(which.max(initial=-1) + 1)
                for g in gains.as_py() or []:
                    gain[g["pos"]] = g["gain"]
                found.append(_features(gain[which], np.array([len(which)]))[0])
            yield _with(batch, kept, np.reshape(found, (-1, 2)))

    return run


def _spelled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo, owner = _windows(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_pydict({"word": batch.column("word").take(pa.array(owner)), "hi": hi, "lo": lo})


def features(rows: DataFrame, kept: str, words: DataFrame, grams: DataFrame, model: str, local: int = LOCAL_GRAMS) -> DataFrame:
    """The columns `kept` of rows with a text, and passage and whole by the evidence of `model`."""
    names = [k.split()[0] for k in kept.split(", ")]
    found = f"{kept}, passage double, whole double"
    if grams.count() <= local:
        table = grams.select("hi", "lo", model).toArrow()
        held = Evidence(*(table[c].to_numpy() for c in ("hi", "lo", model)))
        return rows.mapInArrow(_looked_up(rows.sparkSession.sparkContext.broadcast(pickle.dumps(held)), names), found)
    spelled = words.select("word").mapInArrow(_spelled_out, "word string, hi bigint, lo bigint")
    gain = spelled.join(grams, ["hi", "lo"]).groupBy("word").agg(F.sum(F.col(model).cast("double")).alias("gain"))
    listed = rows.mapInArrow(_listed(names), f"{kept}, words array<string>, which array<int>")
    listed = materialize(listed.withColumn("row", F.monotonically_increasing_id()))
    single = listed.select("row", F.posexplode("words").alias("pos", "word")).join(gain, "word")
    gains = single.groupBy("row").agg(F.collect_list(F.struct("pos", "gain")).alias("gains"))
    return listed.drop("words").join(gains, "row", "left").drop("row").mapInArrow(_joined(names), found)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, the classes weighted alike."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        beta = beta + np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + ridge, gradient)
    return beta


def labelled(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, held_out, toxic, cell, fitted) of all documents. `cell` is the place in CELLS
    of a labelled row outside the held-out fold, else -1; `fitted` marks about `most` of them at most
    for the curve. No text is shuffled unless the labels are too many to broadcast."""
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    fold = fold_of(F.col("doc_id"), 5)
    known = known.where(F.col("toxic").isin(0, 1) & (fold > 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    rows = texts(documents).join(F.broadcast(known) if n <= LOCAL_LABELS else known, "doc_id", "left")
    # The curve is fitted on one half with counts of the other. A hash of the text makes the
    # halves, so that copies of a text are on the same side.
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)) == 0
    cell = F.when(F.col("text").isNotNull(), F.col("toxic") + F.when(half, 0).otherwise(2))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    return rows.select(
        "doc_id", "text", (fold == 0).alias("held_out"), "toxic", F.coalesce(cell, F.lit(-1)).alias("cell"),
        ((F.coalesce(cell, F.lit(-1)) >= 2) & (draw < most / max(1, n))).alias("fitted"),
    )


def judge(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, local: int = LOCAL_GRAMS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = labelled(documents, labels, most)
    plain = texts(documents).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    sizes = {r["toxic"]: r["count"] for r in rows.where(F.col("cell") >= 0).groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return _as_scores(plain, F.lit(float(sizes.get(1, 0) > 0)))
    words = materialize(_sums(rows.select("text", "cell").mapInArrow(_count_words, f"word string, {COUNTS}"), "word"))
    grams = evidence(words)
    tried = features(rows.where("fitted").select("text", "toxic"), "toxic int", words, grams, "half", local)
    seen = tried.toArrow().to_pandas()  # three numbers per row of the bounded sample
    if seen["toxic"].nunique() < 2:
        return _as_scores(plain, F.lit(sizes[1] / sum(sizes.values())))
    weights = [float(w) for w in _logistic(seen[["passage", "whole"]].to_numpy(), seen["toxic"].to_numpy())]
    found = features(plain, "doc_id bigint, held_out boolean", words, grams, "full", local)
    sums = weights[0] + F.col("passage") * weights[1] + F.col("whole") * weights[2]
    return _as_scores(found, 1 / (1 + F.exp(-F.least(F.greatest(sums, F.lit(-50.0)), F.lit(50.0)))))


def _as_scores(rows: DataFrame, score) -> DataFrame:
    rows = rows.select("doc_id", "held_out", score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
