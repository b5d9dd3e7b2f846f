import random
import re

import pytest

from flowlens.llm.components import connected_components
from flowlens.llm.near_dedup import drop_near_copies, near_groups


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def words(dice, n):
    return [dice.choice("abcdefghij") + str(dice.randrange(3000)) for _ in range(n)]


def varied(dice, base, edits):
    text = list(base)
    for _ in range(edits):
        text[dice.randrange(len(text))] = "new" + str(dice.randrange(10**6))
    return text


def collection(seed):
    """Groups of near copies of all sizes around the threshold, copies, a passage in many texts."""
    dice = random.Random(seed)
    passage, texts = words(dice, 55), []
    for _ in range(60):
        texts.append(words(dice, dice.choice([1, 4, 5, 6, 20, 80, 300])))
    for size, length in ((70, 120), (12, 400), (3, 90), (40, 30)):
        base = words(dice, length)
        texts += [varied(dice, base, dice.randrange(1 + length // 18)) for _ in range(size)]
    texts += [words(dice, dice.choice([5, 15, 40, 100])) + passage + words(dice, 10) for _ in range(70)]
    # a chain: each is near the next one, the ends are not near each other
    base = words(dice, 200)
    for step in range(12):
        texts.append(base[step * 8 : step * 8 + 100])
    texts += [dice.choice(texts) for _ in range(40)]
    dice.shuffle(texts)
    joins = [" ", "\n", "\t ", "\x0b"]
    return [(i, dice.choice(joins).join(t).upper() if i % 3 == 0 else " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,size,hot", [(0, 64, 32), (1, 64, 2), (2, 64, 10_000), (3, 128, 5)])
def test_components_equal_brute_force(documents, seed, size, hot):
    rows = collection(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(documents(*rows), size, hot).collect()}
    assert got == brute(rows)


def test_special_rows(documents):
    same = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t"), (4, "word"), (5, "WORD"), (6, "a b"), (7, "b a"), (None, same), (9, same), (8, same.upper()),
            (10, "é È"), (11, "É È"), (12, "x" * 300_000), (13, "y " * 100_000), (14, "y " * 7), (9, same)]
    got = near_groups(documents(*rows)).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_one_id_with_different_texts(documents):
    got = near_groups(documents((1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"))).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1)}


def test_dropping_keeps_one_of_each_component(documents):
    rows = collection(4)
    frame = documents(*rows)
    kept = drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(rows).values()})


def test_empty_table(documents):
    assert near_groups(documents().limit(0)).count() == 0
    assert near_groups(documents((1, None), (2, ""))).count() == 2


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 999), (999, 1000), (5000, 5001), (5000, 5002), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1000: 999, 5000: 5000, 5001: 5000, 5002: 5000}


def test_dropping_repeated_ids_with_unlike_texts(documents):
    one, two, close = "y text one " * 9 + "a b c d e f g", "x unique text of six words", "y text one " * 9 + "a b c d e f"
    rows = [(3, one), (5, two), (5, close), (5, None), (6, close), (None, one), (7, ""), (5, two)]
    frame = documents(*rows)
    kept = drop_near_copies(frame)
    assert kept.schema == frame.schema
    order = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=order)
    assert got == sorted([(3, one), (5, two), (5, two), (5, None), (None, one), (7, "")], key=order)
