import math
import random
import zlib
from collections import Counter
from functools import lru_cache
from string import ascii_lowercase

import numpy as np

from flowlens.llm.toxicity import _logistic, judge

STEMS = ("blorg", "skrunt")


def corpus(n, words=40, seed=0):
    dice = random.Random(seed)
    parts = "an the er ou ti on re st in ly ha nd".split()
    rows, labels = [], []
    for i in range(n):
        text = ["".join(dice.choice(parts) for _ in range(dice.randint(1, 4))) for _ in range(words)]
        toxic = i % 5 == 0
        if toxic:  # every inflection of a stem is its own word
            text[dice.randrange(words)] = dice.choice(STEMS) + "".join(dice.choice(parts) for _ in range(3))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, documents):
    rows, labels = corpus(900)
    got = {r["doc_id"]: r for r in judge(documents(*rows), frame(spark, labels)).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    hits = sum(got[i]["predicted"] for i in held if i % 5 == 0)
    false = sum(got[i]["predicted"] for i in held if i % 5)
    assert len(held) > 100
    assert hits >= 0.9 * sum(i % 5 == 0 for i in held) and false <= 0.05 * len(held)


def test_length_does_not_hide_a_toxic_passage(spark, documents):
    rows, labels = corpus(900)
    long, _ = corpus(2, words=20_000, seed=5)
    clean = long[1][1]
    toxic = clean[: len(clean) // 2] + " blorgtixe skruntbaz blorgan " + clean[len(clean) // 2 :]
    got = {r["doc_id"]: r["score"] for r in judge(documents(*rows, (5000, clean), (5001, toxic)), frame(spark, labels)).collect()}
    assert got[5001] > 0.5 and got[5001] > got[5000]


def test_special_rows(spark, documents):
    rows, labels = corpus(200)
    odd = [(1000, None), (1001, ""), (1002, "!!! \x00"), (None, "blorgan"), (1003, "x" * 300_000), (1004, "same"), (1004, "same")]
    extra = [(1000, 1, 1), (None, 1, 1), (7777, 0, 1), (3, 0, None), (1004, 1, 0), (1004, 1, 0)]
    got = judge(documents(*rows, *odd), frame(spark, labels + extra)).collect()
    assert len(got) == len(rows) + len(odd)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1000] == scores[1001] == scores[1002] < 0.5
    assert all(0 <= s <= 1 for s in scores.values())
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_without_both_classes(spark, documents):
    rows, labels = corpus(30)
    for some in ([], [x for x in labels if x[2] == 0]):
        got = judge(documents(*rows), frame(spark, some)).collect()
        assert {r["score"] for r in got} == {0.0}
    assert judge(documents().limit(0), frame(spark, labels)).count() == 0


def reference(rows, labels, frame):
    """Scores by counts of every n-gram in dictionaries."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    toxic = {i: t for i, _, t in labels if fold[i]}
    half = {r["i"] for r in frame.where("pmod(xxhash64(text, 5), 2) = 0").collect()}

    def model(ids):
        grams = {n: Counter() for n in range(1, 7)}
        for i, text in rows:
            for word in text.split() if i in ids else ():
                spelled = "\0" * 5 + word + "\1"
                for end in range(6, len(spelled) + 1):
                    for n in range(1, 7):
                        grams[n][spelled[end - n : end], toxic[i]] += 1
        kinds = {n: {g for g, _ in grams[n]} for n in grams}
        counts = {n: grams[n] if n > 3 else Counter((g[1:], c) for g in kinds[n + 1] for c in (0, 1)) for n in grams}
        totals, seen = {n: Counter() for n in grams}, {n: Counter() for n in grams}
        for n in grams:
            for (g, c), k in counts[n].items():
                totals[n][g[:-1], c] += k
                seen[n][g[:-1], c] += 1
        alphabet = len(kinds[1]) + 2

        def evidence(word):
            spelled, sums = "\0" * 5 + word + "\1", 0.0
            for end in range(6, len(spelled) + 1):
                likely = [1 / alphabet] * 2
                for n in range(1, 7):
                    g = spelled[end - n : end]
                    for c in (0, 1):
                        if total := totals[n][g[:-1], c]:
                            rest = min(1.0, 0.75 * seen[n][g[:-1], c] / total)
                            likely[c] = max(counts[n][g, c] - 0.75, 0) / total + rest * likely[c]
                sums += math.log(likely[1]) - math.log(likely[0])
            return sums

        return lru_cache(None)(evidence)

    def features(text, evidence):
        gain = [evidence(w) for w in text.split()]
        return max(sum(gain[max(0, i - 3) : i + 1]) / 4 for i in range(len(gain))), sum(gain) / len(gain)

    part = model({i for i in toxic if i in half})
    tried = [(features(t, part), toxic[i]) for i, t in rows if i in toxic and i not in half]
    weights = _logistic(np.array([f for f, _ in tried]), np.array([y for _, y in tried]))
    full = model(set(toxic))
    return {i: 1 / (1 + math.exp(-weights[0] - np.dot(weights[1:], features(t, full)))) for i, t in rows}


def wide_corpus(n, words, seed=3):
    """Every word its own, so that there are many n-grams for few rows."""
    dice = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = ["".join(dice.choices(ascii_lowercase, k=dice.randint(5, 9))) for _ in range(words)]
        toxic = i % 4 == 0
        if toxic:
            text[dice.randrange(words)] = dice.choice(STEMS) + "".join(dice.choices(ascii_lowercase, k=3))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_many_ngrams_share_no_counts(spark, documents):
    rows, labels = wide_corpus(500, 100)
    wanted = reference(rows, labels, spark.createDataFrame(rows, "i bigint, text string"))
    got = {r["doc_id"]: r["score"] for r in judge(documents(*rows), frame(spark, labels)).collect()}
    assert max(abs(got[i] - wanted[i]) for i, _ in rows) < 1e-4


def test_joins_give_what_lookups_give(spark, documents):
    rows, labels = corpus(300)
    odd = [(1000, None), (1001, ""), (None, "blorgan"), (1003, "x" * 3_000), (1004, "blorg same é\U00020000"), (1004, "blorg same é\U00020000")]
    results = []
    for most in (8_000_000, 0):
        got = judge(documents(*rows, *odd), frame(spark, labels), local=most).collect()
        results.append(sorted((r["doc_id"] or -1, r["held_out"], r["predicted"], round(r["score"], 6)) for r in got))
    assert len(results[0]) == len(rows) + len(odd)
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-5 for a, b in zip(*results))


def test_every_labelled_row_is_counted(spark, documents):
    rows, labels = corpus(1200)
    rare = [(2000 + i, f"{text} zwumf{end}") for i, ((_, text), end) in enumerate(zip(corpus(60, seed=9)[0], "an the er ou ti on re st in ly ha nd".split() * 5)) if i % 5]
    taught = [(i, 1, 1) for i, _ in rare[:6]]
    got = {r["doc_id"]: r["predicted"] for r in judge(documents(*rows, *rare), frame(spark, labels + taught), most=40).collect()}
    assert sum(got[i] for i, _ in rare[24:]) >= 20  # of 24
