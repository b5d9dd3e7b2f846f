import re
from collections import Counter
from itertools import permutations

import pytest

from flowlens.llm import filter_audit
from flowlens.llm.filter_audit import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """Per row (part, id, set of the filters it fails), straight from the definitions."""
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words, failing = WORD.findall(text), set()
        if len(words) < 200:
            failing.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failing.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failing.add("C")
        if re.search("[#$%&*|]", text):
            failing.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            failing.add("E")
        out.append((lang or "", doc_id, failing))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing, out, shapley = fails(rows), {}, Counter()
    for part in {p for p, _, _ in failing}:
        mine = [(i, f) for p, i, f in failing if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[part, x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
    return sorted((*key, *counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in out.items())


def labels_frame(spark, rows):
    full = [(i, q, t, "x", 1) for i, q, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, quality int, toxic int, part string, row int")


def long(words, seed, sign=""):
    return " ".join(f"w{seed}x{i}{sign}" for i in range(words))


ROWS = [
    (1, long(220, 1), "en"), (2, long(220, 1), "en"), (2, long(220, 1), "en"), (3, long(199, 2), "en"), (4, None, "de"), (5, "", None),
    (6, "", ""), (7, long(300, 3, "#"), "de"), (8, "the " * 300, "en"), (9, long(200, 4).upper(), "en"), (None, long(220, 1), "fr"),
    (None, "short", "fr"), (10, "a\x0bb c " * 5000 + "Ä" * 200_000, "de"), (11, "A" * 3 + "b" * 97, "en"), (12, "A" * 4 + "b" * 96, "en"),
    (13, "x|" + long(250, 5), "en"), (14, long(220, 1) + " ", "en"), (15, "\n ", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, 1, 0), (7, None, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1), (8, 1, 1)]


@pytest.mark.parametrize("share", [3, 1000])
def test_equals_brute_force(spark, documents, monkeypatch, share):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
    found = audit(documents(*ROWS), labels_frame(spark, LABELS))
    assert found.columns == COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == brute(ROWS, LABELS)


def test_no_plan_holds_all_chains(spark, documents, monkeypatch):
    """Before, one plan had all 49 anti joins of the chains, which took the driver's memory."""
    joins = []

    def counted(df, materialize=filter_audit.materialize):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join LeftAnti"))
        return materialize(df)

    monkeypatch.setattr(filter_audit, "materialize", counted)
    found = audit(documents(*ROWS[:5]), labels_frame(spark, LABELS))
    assert max(joins) <= 12 and sum(joins) in (49, 50)  # one of `copies`
    assert found._jdf.queryExecution().analyzed().toString().count("Join LeftAnti") == 0


def test_clean_rows_and_no_labels(spark, documents):
    rows = [(i, long(210, i), "en") for i in range(3)]
    found = audit(documents(*rows), labels_frame(spark, []))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, [])


def test_empty_table(spark, documents):
    assert audit(documents().limit(0), labels_frame(spark, LABELS)).count() == 0
