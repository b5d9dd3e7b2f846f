import hashlib
import re
from collections import defaultdict

from flowlens.llm.exact_dedup import digests, drop_copies, exact_groups, frequent_digests


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), keep is None or i == keep, sha) for i in ids]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "a b"), (2, ""), (4, None), (None, ""), (6, " "), (6, " "),
    (None, "alone"), (None, "alone"), (7, "x" * 300_000), (8, "x" * 300_000 + "y"), (10, "\x0b"), (11, "é\r\nß"),
]


def test_groups_equal_brute_force(documents):
    for k in (1, 3, 256):
        got = [tuple(r) for r in exact_groups(documents(*ROWS), k).collect()]
        assert sorted(got, key=key) == sorted(brute(ROWS), key=key)


def test_frequent_digests_are_all_found(documents):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 97} {i}") for i in range(900)]
    rows = [(i, "warm" if i % 10 == 1 else t) for i, t in rows]
    found = digests(documents(*rows)).repartition(7)
    got = {bytes(r[0]) for r in frequent_digests(found, 31).collect()}
    assert {hashlib.sha256(t).digest() for t in (b"hot", b"warm")} <= got and len(got) <= 32


def test_dropping_keeps_one_row_of_each_text_with_all_columns(documents):
    frame = documents(*ROWS)
    kept = drop_copies(frame)
    assert kept.columns == frame.columns
    want = sorted((r[0] for r in brute(ROWS) if r[3]), key=lambda x: (x is None, x))
    # rows without an id are never dropped
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted([x for x in got if x is not None]) == [x for x in want if x is not None]
    assert got.count(None) == 3


def test_repeated_ids_with_unlike_texts(documents):
    rows = [(3, "y text one"), (5, "x unique text"), (5, "y text one"), (5, "x unique  text"), (6, "y\ttext one"), (None, "y text one"), (7, None), (7, "z")]
    frame = documents(*rows)
    kept = drop_copies(frame)
    assert kept.schema == frame.schema
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key)
    want = [r for r, b in zip(rows, (True, True, False, True, False, True, True, True)) if b]
    assert got == sorted(want, key=key)


def test_empty_table(documents):
    assert exact_groups(documents().limit(0)).count() == 0
    assert drop_copies(documents().limit(0)).count() == 0
