import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import target_resampling
from flowlens.llm.target_resampling import _planes, buckets_of, resample, weights, word_lists

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def bucket(word):
    return zlib.crc32(word.encode()) % 10000


def brute(rows, target):
    s = Counter(bucket(w) for _, t in rows for w in words(t))
    t = Counter(bucket(w) for text in target for w in words(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        found = words(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in map(bucket, found)
        )
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(able[: 10 * len(able) // 100], 1):
        row[4] = place
    return sorted(map(tuple, out), key=key)


def key(row):
    return tuple((x is None, x) for x in row)


def text_of(dice, n):
    return " ".join(f"{dice.choice(['Wort', 'word', 'éa', '9', 'x_y'])}{int(dice.zipf(1.5)) % 500}" for _ in range(n))


def target_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "item_id bigint, text string, weight int")


def test_equals_brute_force(spark, documents):
    dice = np.random.default_rng(3)
    rows = [(i, text_of(dice, int(n))) for i, n in enumerate(dice.integers(1, 80, 150))]
    rows += [(900, None), (901, ""), (902, "?! \x00\x7f"), (None, text_of(dice, 50)), (903, text_of(dice, 60_000)), (904, "same " * 70_000)]
    rows += [(905, rows[3][1] + " " + rows[5][1])] * 3 + [(906 + i, rows[7][1] + " twenty" * 20) for i in range(20)]
    target = [text_of(dice, 40) for _ in range(5)] + [None, "same word"]
    found = resample(documents(*rows), target_frame(spark, target))
    assert sorted((tuple(r) for r in found.collect()), key=key) == brute(rows, target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("target", [[], [None]])
def test_nothing_to_aim_at(spark, documents, target):
    rows = [(i, f"a{i} b c " * 10) for i in range(30)]
    found = resample(documents(*rows), target_frame(spark, target))
    assert sorted((tuple(r) for r in found.collect()), key=key) == brute(rows, target)


def test_empty_table(spark, documents):
    assert resample(documents().limit(0), target_frame(spark, ["a b"])).count() == 0


def test_words_of_slices_and_odd_bytes():
    texts = ["xx", None, "ÀbC-9 z", "", "\x00a\x7f", " A  ", "𝔘n{i}"]
    column = pa.array(texts)[1:]
    flat, ends = word_lists(column)
    lists = np.split(np.array(flat.to_pylist(), object), ends[:-1])
    assert [list(x) for x in lists] == [words(t) for t in texts[1:]]
    found, _ = buckets_of(column)
    assert found.tolist() == [bucket(w) for t in texts[1:] for w in words(t)]


def test_planes_give_exact_weights():
    dice = np.random.default_rng(0)
    gain = dice.integers(-30_000, 30_000, target_resampling.BUCKETS)
    found = [dice.integers(0, 10_000, 500), np.empty(0, np.int64), np.full(100_000, 9_999), np.repeat([1, 2], [2, 4])]
    ends = np.cumsum([len(f) for f in found])
    got = weights(np.concatenate(found), ends, _planes(np.maximum(gain, 0)), _planes(np.maximum(-gain, 0)))
    assert got.tolist() == [int(gain[f].sum()) for f in found]
