"""Token ids of many texts by way of their distinct words.

For a tokenizer that treats the words between white space independently of each other, the ids of
a text are those of its words in a row. A word is then encoded once per batch and worker instead of
once per occurrence. The words are split, numbered and gathered by Arrow and NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words held per worker, about. They only save time, ids don't depend on them.
CACHE_WORDS = 250_000
#: Text handled at once; a single longer text is handled alone.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with about `most` bytes of text in `column`. The rows are copied:
    some string kernels of Arrow misread arrays that begin inside another one's buffers. What the
    slices took is given back in the end, since workers live on from stage to stage."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    share = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.take(pa.array(np.arange(start, end)))
    pa.default_memory_pool().release_unused()


Coded = tuple[np.ndarray, np.ndarray]  # ids of all words one after the other, number of each word's


def flattened(ids: Sequence[Sequence[int]], dtype: str = "<u4") -> Coded:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for row in ids for x in row), dtype, int(sizes.sum())), sizes


def merged(first: np.ndarray, yes: Coded, no: Coded) -> Coded:
    """Words of two codings in one order: `first` says which of them is next."""
    sizes = np.empty(len(first), np.int64)
    sizes[first], sizes[~first] = yes[1], no[1]
    which = np.repeat(first, sizes)
    flat = np.empty(len(which), yes[0].dtype)
    flat[which], flat[~which] = yes[0], no[0]
    return flat, sizes


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`slices` of all batches; a batch is let go before the next one is asked for."""
    for batch in batches:
        yield from slices(batch, column, most)
        del batch


class WordIds:
    """Encodes arrays of texts. `encode` gives the ids of a list of words, `split` cuts an array of
    texts into a list array of words.

    Words are held in two generations. What is looked up moves to the young one; when that is full
    the old one goes and the young one takes its place, so that frequent words stay."""

    def __init__(
        self,
        encode: Callable[[list[str]], Coded],
        split: Callable[[pa.Array], pa.Array] = pc.ascii_split_whitespace,
        dtype: str = "<u4",
        max_words: int = CACHE_WORDS,
    ):
        self._encode, self._split, self._dtype, self._max = encode, split, np.dtype(dtype), max_words
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        young, old = self._young, self._old
        found = list(map(young.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        new = []
        for i in missing:
            f = old.get(words[i])
            if f is None:
                new.append(i)
            else:
                found[i] = young[words[i]] = f
        if new:
            flat, sizes = self._encode([words[i] for i in new])
            raw, ends = flat.astype(self._dtype, copy=False).tobytes(), (np.cumsum(sizes) * self._dtype.itemsize).tolist()
            for i, start, end in zip(new, [0, *ends], ends):
                found[i] = young[words[i]] = raw[start:end]
        if len(young) > self._max // 2:
            self._young, self._old = {}, young
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, end of each text's ids). NULL counts as empty."""
        lists = self._split(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.asarray(lists.offsets, dtype=np.int64)
        words = lists.flatten().dictionary_encode()
        if len(words) == 0:
            return np.empty(0, self._dtype), np.zeros(len(texts), np.int64)
        coded = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist takes ten times as long
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self._dtype.itemsize
        flat, firsts = np.frombuffer(b"".join(coded), self._dtype), np.cumsum(sizes) - sizes
        which = words.indices.to_numpy(zero_copy_only=False)
        per_word = sizes[which]
        word_ends = np.cumsum(per_word)
        # the i-th id of an occurrence stands i places after the word's first id
        at = np.repeat(firsts[which] - (word_ends - per_word), per_word)
        at += np.arange(word_ends[-1])
        before = np.concatenate([[0], word_ends])
        return flat[at], before[ends[1:] - ends[0]]
