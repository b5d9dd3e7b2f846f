"""Language identification by error-correcting output codes.

Every language has a codeword of bits. A binary classifier per bit tells the languages with that bit
set from the others: a linear model over hashed character n-grams, whose weights are log ratios of
the two sides' n-gram frequencies (naive Bayes). Its margin for a text is the mean weight per n-gram.
Decoding sums over the bits the loss of the margin against each language's bit, weighted by how
reliable the bit's classifier proved on the sample, and takes the language with the least loss. The
score is the softmax of the losses; a text whose two best languages score alike is ambiguous.

The classifiers learn from a bounded sample: TRAIN_PER_LANGUAGE rows of each language, chosen by a
hash of the id. Prediction reads whole texts in one pass and needs no shuffle.

Defined results: a text that is NULL or has no letter is `und` with score 0, and so is every text
when nothing can be learned. Rows without a language or an id teach nothing; rows without an id
count as not held out. Equal losses go to the language first in the alphabet.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import workers
from flowlens.llm.tables import fold_of, in_small_batches, materialize, texts
from flowlens.llm.word_cache import sliced

TRAIN_PER_LANGUAGE = 5_000
SLOTS = 1 << 15  # of the hashed n-grams of one length
ORDERS = (2, 3)  # n-gram lengths
AMBIGUOUS = 0.1  # difference of the two best scores below which a text is ambiguous
CHUNK = 1 << 20  # characters handled at once
SHARPNESS = 8.0  # margins are scaled so that typical ones lie well off the bend of the loss
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(text: str) -> tuple[np.ndarray, int]:
    """Slots of all n-grams of a text (orders one after the other), and its number of letters."""
    # surrogates can't occur in Arrow strings; words are set apart by one or more spaces
    points = _folding()[np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)]
    letters = int(np.count_nonzero(points != 32))
    keep = (points != 32) | np.concatenate([[True], points[:-1] != 32])  # runs of spaces as one
    points = points[keep]
    found = []
    for i, n in enumerate(ORDERS):
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x9E3779B1) + points[j : len(points) - n + 1 + j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        found.append((h >> np.uint32(32 - 15)) + np.uint32(i * SLOTS))
    return (np.concatenate(found) if found else np.empty(0, np.uint32)), letters


def codewords(classes: int) -> np.ndarray:
    """A code of -1 and 1, one row per class: every way to split up to five classes in two,
    beyond that columns drawn with a fixed seed, the draw with the largest least distance."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        columns = [[1] + [1 if (c >> j) & 1 else -1 for j in range(classes - 1)] for c in range(2 ** (classes - 1) - 1)]
        return np.array(columns, np.int8).T
    dice, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(classes)))
    best, best_distance = None, -1
    for _ in range(50):
        code = dice.choice(np.array([-1, 1], np.int8), (classes, bits))
        apart = (bits - code.astype(int) @ code.T) // 2
        least = apart[~np.eye(classes, dtype=bool)].min()
        splits = np.all(np.abs(code.sum(0)) < classes)
        if splits and least > best_distance:
            best, best_distance = code, least
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    reliability: np.ndarray  # per bit

    def margins(self, text: str) -> np.ndarray | None:
        total, grams, letters = np.zeros(self.weights.shape[1]), 0, 0
        for start in range(0, len(text), CHUNK):
            slots, n = _grams(text[start : start + CHUNK])
            # counts first: a long text has more n-grams than there are slots
            total += (
                np.bincount(slots, minlength=len(self.weights)) @ self.weights
                if len(slots) > len(self.weights)
                else self.weights[slots].sum(0)
            )
            grams, letters = grams + len(slots), letters + n
        return None if letters == 0 else total / grams

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        margins = self.margins(text) if text and self.languages else None
        if margins is None:
            return UNKNOWN, 0.0, False
        loss = np.log1p(np.exp(np.clip(-SHARPNESS * self.code * margins, -500, 500))) @ self.reliability
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(np.argmin(loss))
        second = np.partition(share, -2)[-2] if len(share) > 1 else 0.0
        return self.languages[best], float(share[best]), bool(share[best] - second < AMBIGUOUS)


def _fit(languages: tuple[str, ...], counts: np.ndarray) -> Model:
    """counts: languages x slots. Each side of a bit is the mean of its languages' frequencies, so
    that a frequent language doesn't speak for its side alone."""
    code = codewords(len(languages))
    weights = np.zeros((len(ORDERS) * SLOTS, code.shape[1]), np.float32)
    smooth = counts + 0.5
    for i in range(len(ORDERS)):
        part = slice(i * SLOTS, (i + 1) * SLOTS)
        share = smooth[:, part] / smooth[:, part].sum(1, keepdims=True)
        for bit in range(code.shape[1]):
            yes, no = code[:, bit] > 0, code[:, bit] < 0
            if yes.any() and no.any():
                weights[part, bit] = np.log(share[yes].mean(0) / share[no].mean(0))
    return Model(languages, code, weights, np.ones(code.shape[1]))


def _counting(languages: tuple[str, ...]):
    index = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), len(ORDERS) * SLOTS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for start in range(0, len(text), CHUNK):
                    slots, _ = _grams(text[start : start + CHUNK])
                    counts[index[lang]] += np.bincount(slots, minlength=counts.shape[1])
        seen = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_pydict(
            {"lang": [languages[i] for i in seen], "counts": [counts[i].tobytes() for i in seen]},
            pa.schema([("lang", pa.string()), ("counts", pa.binary())]),
        )

    return workers.lean(run)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in group["counts"])
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "counts": [total.tobytes()]})


def _errors(model: Model):
    index = {lang: i for i, lang in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, n = np.zeros(model.code.shape[1]), 0
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                margins = model.margins(text)
                if margins is not None:
                    wrong += margins * model.code[index[lang]] <= 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"bit": list(range(len(wrong))), "wrong": wrong, "n": [n] * len(wrong)})

    return workers.lean(run)


def training_sample(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(text, lang): about `per_language` rows of each language outside the held-out fold."""
    rows = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"),
        documents["text"].cast("string").alias("text"),
        documents["lang"].cast("string").alias("lang"),
    )
    fold = fold_of(F.col("doc_id"), 4)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold >= 0) & (fold != 2))
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], per_language / r["count"]).otherwise(share)
    return rows.where(draw < share).select("text", "lang")


def learn(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    sample = materialize(training_sample(documents, per_language))
    languages = tuple(sorted(r["lang"] for r in sample.select("lang").distinct().collect()))
    if not languages:
        return Model((), codewords(0), np.zeros((len(ORDERS) * SLOTS, 1), np.float32), np.ones(1))
    # The sample is bounded, and so are partitions x languages rows of counts.
    parts = sample.coalesce(8).mapInArrow(_counting(languages), "lang string, counts binary")
    summed = parts.groupBy("lang").applyInPandas(_added, "lang string, counts binary").collect()
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in summed}
    model = _fit(languages, np.stack([counts[lang] for lang in languages]).astype(np.float64))
    tried = sample.mapInArrow(_errors(model), "bit bigint, wrong double, n bigint")
    rates = {r["bit"]: r["w"] / max(1, r["n"]) for r in tried.groupBy("bit").agg(F.sum("wrong").alias("w"), F.sum("n").alias("n")).collect()}
    reliability = np.array([max(0.05, 1 - 2 * rates.get(b, 0.0)) for b in range(model.code.shape[1])])
    return Model(model.languages, model.code, model.weights, reliability / reliability.mean())


def _decoded(held, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = workers.unpickled(key, held)
        for batch in batches:
            found = [model.decode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return workers.lean(run, key)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    raw = pickle.dumps(model)
    held = documents.sparkSession.sparkContext.broadcast(raw)
    rows = texts(documents)
    rows = rows.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(_decoded(held, workers.key_of(raw)), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    return predict(documents, learn(documents, per_language))


def _identified(held, key: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = workers.unpickled(key, held)
        for batch in sliced(batches, column):
            found = [model.decode(t.as_py()) for t in batch.column(column)]
            yield batch.filter(pa.array([lang != UNKNOWN and not unsure for lang, _, unsure in found], pa.bool_()))

    return workers.lean(run, key)


def keep_identified(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """The documents, with their columns, whose language is told and not ambiguous. Without
    anything to learn from no document can be judged, and all with a letter would go; they stay."""
    model = learn(documents, per_language)
    if not model.languages:
        return documents
    raw = pickle.dumps(model)
    held = documents.sparkSession.sparkContext.broadcast(raw)
    column = [c.lower() for c in documents.columns].index("text")
    return in_small_batches(documents).mapInArrow(_identified(held, workers.key_of(raw), column), documents.schema)
