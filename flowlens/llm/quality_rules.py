"""Quality of documents: fixed rules, and boosted trees over statistics of the text.

One pass over the texts gives each document a row of counts. Bytes are counted by class with one
bincount per slice; words and lines are numbered by a dictionary, and repeats found by sorting the
numbers. A bounded sample of labelled rows (TRAIN_ROWS, those with the smallest hash of their id)
fits gradient-boosted trees on the driver. They are flattened to node arrays, sent to the tasks, and
score all rows at once. The more signs, capitals, repeated words or repeated lines a text has, the
lower its score may only get, whatever the sample says.

A document is kept if it passes the rules and the trees find it at least as likely good as not.

Defined results: a NULL or empty text has no words and fails the rules. Repeated rows are judged
each; of repeated labels of a document the smallest counts, and a row without doc_id has none.
Without labels of both kinds the rules alone decide. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import boosted_trees
from flowlens.llm.tables import materialize, texts
from flowlens.llm.word_cache import slices

TRAIN_ROWS = 20_000  # labelled rows that the trees are fitted on, at most
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
KEEP = 0.5  # probability of being good

#: Classes of bytes; 0 is everything else.
_SPACE, _NEWLINE, _SYMBOL, _CAPITAL, _DIGIT, _MARK, _STOP, _INNER = range(1, 9)
_CLASSES = 9
STEP = 1 << 20  # bytes counted at once


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[0x80:0xC0] = _INNER  # bytes after the first of a character
    groups = {
        _SPACE: b" \x09\x0b\x0c\x0d", _NEWLINE: b"\n", _SYMBOL: b"#*$%&|<>", _CAPITAL: bytes(range(0x41, 0x5B)),
        _DIGIT: bytes(range(0x30, 0x3A)), _MARK: b"!\"'()+,-/:;=?@[\\]^_`{}~", _STOP: b".",
    }
    for number, group in groups.items():
        table[list(group)] = number
    return table


_TABLE = _classes()

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_capitals", "n_digits", "n_marks", "n_stops", "longest",
)
_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

#: What the trees see, and which way a score may go with it.
FEATURES = {
    "words": 0, "word_length": 0, "longest": 0, "line_words": 0, "digits": 0, "marks": 0, "stops": 0,
    "distinct": 1, "symbols": -1, "capitals": -1, "dup_lines": -1, "repeats": -1,
}


def _byte_classes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(text, class): bytes of each class in each text, in steps of STEP bytes however long a text is."""
    n = len(at) - 1
    out = np.zeros(n * _CLASSES, np.int64)
    for start in range(0, len(raw), STEP):
        some = raw[start : start + STEP]
        cuts = np.clip(at, start, start + len(some))
        out += np.bincount(np.repeat(np.arange(n) * _CLASSES, np.diff(cuts)) + _TABLE[some], minlength=len(out))
    return out.reshape(n, _CLASSES)


def _filled(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(items that aren't empty, end of each list's items)."""
    flat, at = lists.flatten(), np.asarray(lists.offsets, np.int64)
    full = np.asarray(pc.not_equal(flat, ""))
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at - at[0]]


def _codes(items: pa.Array) -> np.ndarray:
    return items.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(codes: np.ndarray, which: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per text the words that lie in a window of `window` words which its text has twice or more.
    Windows are numbered exactly, one more word at a time."""
    out = np.zeros(n, np.int64)
    places = len(codes) - window + 1
    if places < 2:
        return out
    inside = which[:places] == which[window - 1 :]
    start = np.flatnonzero(inside)
    number, width = which[start], int(codes.max()) + 1
    for j in range(window):
        _, number = np.unique(number * width + codes[start + j], return_inverse=True)
    twice = start[np.bincount(number)[number] > 1]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    hit = np.cumsum(covered[:-1]) > 0
    return np.bincount(which[hit], minlength=n)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text; NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    kind = _byte_classes(raw, at - at[0])

    words, ends = _filled(pc.ascii_split_whitespace(column))
    per_text = np.diff(ends)
    owner, code = np.repeat(np.arange(n), per_text), _codes(words)
    distinct = np.unique(owner * (int(code.max(initial=0)) + 1) + code)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)

    lines, line_ends = _filled(pc.split_pattern(column, "\n"))
    with_word = np.asarray(pc.match_substring_regex(lines, r"[^\x09-\x0D ]"))
    line_owner = np.repeat(np.arange(n), np.diff(line_ends))[with_word]
    line_code = _codes(lines.filter(pa.array(with_word)))
    n_lines = np.bincount(line_owner, minlength=n)
    once = np.unique(line_owner * (int(line_code.max(initial=0)) + 1) + line_code)
    distinct_lines = np.bincount(once // (int(line_code.max(initial=0)) + 1), minlength=n)
    return {
        "n_words": per_text,
        "word_chars": kind.sum(1) - kind[:, _INNER] - kind[:, _SPACE] - kind[:, _NEWLINE],
        "n_symbols": kind[:, _SYMBOL],
        "n_dup_lines": n_lines - distinct_lines,
        "n_repeat_words": repeated_words(code, owner, n),
        "n_lines": n_lines,
        "n_distinct": np.bincount(distinct // (int(code.max(initial=0)) + 1), minlength=n),
        "n_capitals": kind[:, _CAPITAL], "n_digits": kind[:, _DIGIT], "n_marks": kind[:, _MARK], "n_stops": kind[:, _STOP],
        "longest": longest,
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "text")):
        found = counts(batch.column("text"))
        arrays = [pa.array(np.asarray(found[c], np.int64)) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *COUNTS])


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each document's whole text."""
    return texts(documents).mapInArrow(_counted, _SCHEMA)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The FEATURES of rows of counts, in order."""
    c = {name: np.asarray(column, np.float64) for name, column in c.items()}
    words, chars, lines = (np.maximum(c[x], 1) for x in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            c["n_words"], c["word_chars"] / words, c["longest"], c["n_words"] / lines, c["n_digits"] / chars, c["n_marks"] / chars,
            c["n_stops"] / words, c["n_distinct"] / words, c["n_symbols"] / chars, c["n_capitals"] / chars,
            c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        ],
        axis=1,
    )


def learn(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> boosted_trees.Model:
    """Trees fitted on at most `most` labelled rows of `statistics`."""
    good = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("good"))
    good = good.where("doc_id IS NOT NULL AND good IN (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    drawn = stats.join(good, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", *COUNTS).limit(most).toPandas()
    x = features({c: drawn[c].to_numpy() for c in COUNTS})
    return boosted_trees.train(x, drawn["good"].to_numpy(np.float64), np.array(list(FEATURES.values())))


def _scored(model: boosted_trees.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.probability(x))], [*batch.schema.names, "score"]
            )

    return run


def judge(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score."""
    stats = materialize(statistics(documents))
    model = learn(stats, labels, most)
    scored = stats.mapInArrow(_scored(model), f"{_SCHEMA}, score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    verdict = F.lit(True) if not len(model.roots) else F.col("score") >= keep
    return scored.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict).alias("kept"), "score")
