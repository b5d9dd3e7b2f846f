"""Packing by concatenation: all documents in one stream of tokens, cut every 4096 tokens.

A pass over the texts writes each document's ids, its place within its partition and its partition
to the shared folder. Prefix sums over the partitions' totals (one row per partition) and the place
within the partition give every document its global offset, so nothing is sorted and nothing but the
totals is brought together. The window of an id is its offset divided by the length of a window;
a document on a boundary has a piece on either side. Since the numbered ids are read from the
written table, a repeated task meets the same partitions again.

Defined results: a NULL text counts as empty and has one token, the separator. Rows without doc_id
and repeated rows are packed like others. An empty table gives no rows. Only the last sequence can
be short; `padded_length` is what it is padded to: nothing at a power of two, else the full length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm import workers
from flowlens.llm.tables import materialize, texts
from flowlens.llm.word_cache import WordIds, flattened, merged, sliced

SEQUENCE = 4096
SEPARATOR = 2
CACHE_WORDS = 160_000  # held per worker, about


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the installed file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that the tokenizer's first step takes as such, and ASCII signs that always end a run of
#: them. No apostrophe, which may begin a contraction, and no bar, which special tokens hold.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{}~"
_PLAIN = re.compile(f"[{_LETTERS}]+")


def _cut(texts_: pa.Array) -> pa.Array:
    """Texts cut at white space and between letters and signs, A-Z in lower case: both are what the
    tokenizer does first, and few distinct words are left. A text that may hold special tokens,
    which are written in lower case, keeps its letters."""
    low = pc.if_else(pc.match_substring(texts_, "<|"), texts_, pc.ascii_lower(texts_))
    for before, after in ((_LETTERS, _SIGNS), (_SIGNS, _LETTERS)):
        low = pc.replace_substring_regex(low, f"([{before}])([{after}])", "\\1 \\2")
    return pc.ascii_split_whitespace(low)


def _byte_letters() -> dict[int, str]:
    """How byte-level models write Latin-1 letters: each byte of UTF-8 as a character of its own.
    Printable bytes stand for themselves, the others are numbered from 256 (a fixed rule)."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    sign = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Words:
    """Ids of words. Those of letters alone go straight to the merges, past the tokenizer's
    normaliser and splitting, which take most of its time and would change nothing. They go there
    many in one string, cut at blanks: a word's last id stands for a piece that ends a word, which
    tells where it ends. All others take the whole way, one by one."""

    TOGETHER = 2048  # words of letters in a string

    def __init__(self, path: str):
        # a task has the cores Spark gave it; threads beyond these only bring heaps of their own
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.code_points = np.arange(256, dtype="<u2")
        for c, sign in _byte_letters().items():
            self.code_points[list(chr(c).encode())] = [ord(x) for x in sign]
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        pieces = self.whole.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.ends_word[[i for piece, i in pieces.items() if suffix and piece.endswith(suffix)]] = True
        sample = ["word", "Ünïcödé", "STRASSE", "ß", "ÿÀ", "antidisestablishmentarianismus"]
        self.direct = bool(suffix) and self._letters(sample) is not None and all(
            np.array_equal(x, y) for x, y in zip(self._whole(sample), self._letters(sample))
        )

    def _whole(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)])

    def _letters(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """None if the ids don't show where the words end."""
        joined = (" ".join(words[i : i + self.TOGETHER]).lower() for i in range(0, len(words), self.TOGETHER))
        written = [self.code_points[np.frombuffer(x.encode(), np.uint8)].tobytes().decode("utf-16-le") for x in joined]
        found = [np.array(e.ids, "<u4") for e in self.merges.encode_batch_fast(written, add_special_tokens=False)]
        flat = np.concatenate([np.empty(0, "<u4"), *found])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(flat)):
            return None
        return flat, np.diff(ends, prepend=0)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self.direct and _PLAIN.fullmatch(w) is not None for w in words]
        letters = self._letters([w for w, p in zip(words, plain) if p])
        if letters is None:
            return self._whole(words)
        return merged(np.array(plain, bool), letters, self._whole([w for w, p in zip(words, plain) if not p]))


def word_tokenizer(path: str) -> WordIds:
    """The tokenizer of a file that drops white space and never joins words across it. The splits
    at white space come first in it, and its normaliser works character by character."""
    return workers.model(("words", path), lambda: WordIds(_Words(path).encode, _cut, max_words=CACHE_WORDS))


def _tokenised(path: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        tokenizer = word_tokenizer(path)
        for batch in sliced(batches, "text"):
            ids, ends = tokenizer.ids(batch.column("text"))
            ids = np.insert(ids, ends, separator)
            ends = ends + np.arange(1, len(ends) + 1)
            n = np.diff(ends, prepend=0)
            # two bytes hold every id of this vocabulary; a larger one keeps four
            small = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
            raw = small.tobytes()
            offsets = pa.py_buffer(np.concatenate([[0], ends * small.itemsize]).astype("<i4").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), packed, pa.array(np.full(len(n), small.itemsize, np.int32)),
                    pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n),
                ],
                ["doc_id", "ids", "width", "doc_tokens", "part", "before"],
            )
            before += int(ends[-1]) if len(ends) else 0

    return workers.lean(run, ("words", path))


def tokenised(documents: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, ids, width, doc_tokens, part, before): ids as little-endian integers of `width`
    bytes with the separator at the end, and the tokens before them in their partition."""
    schema = "doc_id bigint, ids binary, width int, doc_tokens bigint, part int, before bigint"
    return texts(documents).mapInArrow(_tokenised(path, separator), schema)


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            n, widths = batch.column("doc_tokens").to_numpy(), batch.column("width").to_numpy()
            first, last = start // length, (start + n - 1) // length
            row = np.repeat(np.arange(len(n)), last - first + 1)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            begin = np.maximum(start[row], sequence * length)
            end = np.minimum(start[row] + n[row], (sequence + 1) * length)
            crc, ids, held = np.empty(len(row), np.int64), batch.column("ids"), -1
            for i, r in enumerate(row):
                if r != held:
                    held, whole = r, np.frombuffer(ids[r].as_py(), f"<u{widths[r]}").astype("<u4")
                crc[i] = zlib.crc32(whole[begin[i] - start[r] : end[i] - start[r]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(begin - start[row]), pa.array(end - begin),
                    pa.array(crc), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return workers.lean(run)


def concatenate_and_cut(
    documents: DataFrame, path: str | None = None, length: int = SEQUENCE, separator: int = SEPARATOR
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length."""
    rows = materialize(tokenised(documents, path or vocabulary(), separator))
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    # one row per partition of the input, numbered in one task: no more rows than there were tasks
    running = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    base = totals.select("part", (running - F.col("tokens")).alias("base"))
    placed = rows.join(F.broadcast(base), "part")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    pieces = placed.select("doc_id", "ids", "width", "doc_tokens", "before", "base").mapInArrow(_pieces(length), schema)
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    rest = total % length
    short = rest if rest and rest & (rest - 1) == 0 else length
    return pieces.withColumn(
        "padded_length", F.when(F.col("sequence_id") == total // length, F.lit(short)).otherwise(F.lit(length)).cast("bigint")
    )
