import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import boosted_trees, quality_rules
from flowlens.llm.quality_rules import FEATURES, counts, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


ODD = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n x\nx \n\nx", "é ß 𝔘#|<\x0b\x0c>&", "\x1c\x85 a\xa0b",
    "a b c\n" * 40_000, "one\r\none\r\none", " ".join(f"w{i % 7919}" for i in range(120_000)), "a b a b a b a", "𝔘" * 300_000,
]


def test_counts_equal_brute_force():
    dice = np.random.default_rng(4)
    texts = ODD + ["".join(dice.choice(list("ab \n#é|"), int(n))) for n in dice.integers(0, 200, 300)]
    for column in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts[:3])):
        found = counts(column)
        assert np.stack([found[c] for c in BASE], 1).tolist() == [brute(t) for t in column.to_pylist()]


def test_long_texts_in_steps(monkeypatch):
    texts = ["ab#\n" * 5, "", "é " * 20, None, "x"]
    want = counts(pa.array(texts))
    monkeypatch.setattr(quality_rules, "STEP", 7)
    got = counts(pa.array(texts))
    assert all((got[c] == want[c]).all() for c in want)


def labels_frame(spark, rows):
    return spark.createDataFrame([(i, q, 0, 1.0) for i, q in rows], "doc_id bigint, quality int, toxic int, score double")


def prose(dice, n, sign=""):
    return " ".join("".join(dice.choice(list("abcdeio"), int(k))) + sign for k in dice.integers(2, 9, n))


def corpus():
    """(rows, labels): plain prose is good; prose full of signs, shouted or repeated is not."""
    dice, rows, labels = np.random.default_rng(6), [], []
    for i in range(360):
        n = int(dice.integers(60, 200))
        text = [prose(dice, n), prose(dice, n), prose(dice, n, "***"), prose(dice, n).upper(), (prose(dice, 8) + "\n") * (n // 8)][i % 5]
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(i % 5 < 2)))
    return rows, labels


def test_rules_and_held_out_verdicts(spark, documents):
    rows, labels = corpus()
    extra = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]
    frame = labels_frame(spark, labels + [(None, 0), (5, 1), (5, 1), (7777, 0)])
    got = judge(documents(*rows, *extra), frame).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    for i, text in rows + extra:
        want = brute(text)
        assert [by_id[i][c] for c in BASE] == want
        assert by_id[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (by_id[i]["base_failed"] and by_id[i]["kept"]) and 0 <= by_id[i]["score"] <= 1
    held = [i for i, _ in rows if i % 3 == 0]
    assert np.mean([by_id[i]["kept"] == (i % 5 < 2) for i in held]) > 0.97


def test_nothing_to_learn_from(spark, documents):
    rows = [(1, "a b"), (2, " ".join(f"w{i}" for i in range(60))), (3, None)]
    for labels in ([], [(1, None)], [(1, 1), (2, 1)]):
        got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judge(documents(*rows), labels_frame(spark, labels)).collect()}
        assert got == {1: (True, False), 2: (False, True), 3: (True, False)}
    assert judge(documents().limit(0), labels_frame(spark, [])).count() == 0


def test_sample_is_bounded(spark, documents):
    rows, labels = corpus()
    stats = quality_rules.statistics(documents(*rows))
    seen = []
    real = boosted_trees.train
    try:
        boosted_trees.train = lambda x, y, d: seen.append(len(y)) or real(x, y, d)
        quality_rules.learn(stats, labels_frame(spark, labels), most=50)
    finally:
        boosted_trees.train = real
    assert seen == [50]


def noisy(n=3000):
    dice = np.random.default_rng(2)
    x = np.round(dice.normal(size=(n, 4)), 1)
    wave = 2 * x[:, 0] + 3 * np.sin(3 * x[:, 0]) - x[:, 1] + 2 * (x[:, 2] > 0) * x[:, 3]
    return x, (wave + dice.normal(size=n) > 0).astype(float)


@pytest.mark.parametrize("directions", [(1, -1, 0, 0), (0, 0, 0, 0), (1, -1, 1, 1)])
def test_trees_are_monotonic_and_flat(directions):
    x, y = noisy()
    model = boosted_trees.train(x, y, np.array(directions))
    for f, way in enumerate(directions):
        if way:
            for row in x[:40]:
                line = np.repeat(row[None, :], 81, 0)
                line[:, f] = np.linspace(-4, 4, 81)
                assert (way * np.diff(model.margin(line)) >= -1e-12).all()
    if not any(directions):
        rises = [np.diff(model.margin(np.column_stack([np.linspace(-2, 2, 41), *np.zeros((3, 41))])))]
        assert (rises[0] < 0).any()  # the constraint is what makes it monotonic
        assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    # node by node, as a tree is read
    for row, margin in zip(x[:50], model.margin(x[:50])):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (row[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        assert abs(total - margin) < 1e-9


def test_one_class_gives_no_trees():
    for y in (np.zeros(0), np.ones(5)):
        model = boosted_trees.train(np.zeros((len(y), len(FEATURES))), y, np.zeros(len(FEATURES)))
        assert not len(model.roots) and (model.probability(np.zeros((3, len(FEATURES)))) >= 0.5).all()
