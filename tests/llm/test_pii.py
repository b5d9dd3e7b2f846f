import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flowlens.llm import pii
from flowlens.llm.pii import KINDS, base_spans, personal_data, redact, reliabilities, posterior

# The definitions as they stand, without any shortcut
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return found


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.-_+ ()0123456789é", max_size=60))
def test_base_spans_equal_the_definitions(text):
    assert base_spans(text) == brute(text)


@pytest.mark.parametrize("text", [
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "x4111111111111111y", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255",
    "+1 (269) 555-3296", "+12--", "a@b.c@d.e", "a.b+c@x-y.z.w.", "00001.2.3.4", "@a.b", "é@b.co",
])
def test_examples(text):
    assert base_spans(text) == brute(text)


ROWS = [
    (1, "mail me: joe.x@mail.example.com or +1 (269) 555-3296 4524132264652876 end"),
    (2, "nothing here at all, version 1.2.3.4000 and 2020"), (3, None), (4, ""), (None, "ip 10.0.0.1 x"),
    (5, "card 4111 1111 1111 1111, again 4111 1111 1111 1111"), (6, "9" * 200_000), (7, "+1" + "(" * 100_000), (8, "a@" * 50_000),
    (9, "same 1.1.1.1"), (9, "same 1.1.1.1"),
]
CARDS = ("4556 7375 8689 9855", "4556737586899855")
TRAINING = [(100 + i, f"call +1 (2{i % 90 + 10}) 555-{i % 9000 + 1000} or card {CARDS[i % 2]} at 10.0.{i % 250}.7 mail a{i}@b.com") for i in range(300)]
TRAINING += [(500 + i, f"the {'red green blue'.split()[i % 3]} {CARDS[1]} and") for i in range(300)]


def test_rows_of_the_query(documents):
    got = personal_data(documents(*ROWS, *TRAINING)).collect()
    assert len(got) == len(ROWS) + len(TRAINING)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in ROWS + TRAINING[:20]:
        r, base = by_id[doc_id], brute(text or "") if len(text or "") < 1000 else base_spans(text)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert set(said.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r["n_added"]
    # both numbers are lost to the base patterns, as one runs into the other
    text = ROWS[0][1]
    added = [s.split(":") for s in by_id[1]["spans"].split(",")]
    assert {(k, text[int(s) : int(e)]) for k, s, e in added} >= {("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")}
    assert by_id[2]["spans"] == ""


def test_redaction(documents):
    frame = documents(*ROWS, *TRAINING)
    out = redact(frame)
    assert out.schema == frame.schema and out.count() == frame.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[1]["text"] == "mail me: [EMAIL] or [PHONE] [CARD] end" and by_id[1]["n_chars"] == len(by_id[1]["text"])
    assert by_id[2]["text"] == ROWS[1][1] and by_id[3]["text"] is None
    assert by_id[None]["text"] == "ip [IP] x"


def test_estimated_reliabilities_find_the_better_labeler():
    dice = np.random.default_rng(3)
    patterns = {}
    for _ in range(4000):
        true = dice.random() < 0.6
        said = "".join("yn"[int((dice.random() < p) != true)] for p in (0.95, 0.9, 0.6))
        patterns[said] = patterns.get(said, 0) + 1
    prior, table = reliabilities(patterns)
    assert abs(prior - 0.6) < 0.05
    assert table[1, 0, 0] > 0.9 and table[0, 0, 1] > 0.9 and 0.5 < table[1, 2, 0] < 0.7
    assert posterior(["yyn", "nny"], prior, table)[0] > 0.9 > 0.1 > posterior(["yyn", "nny"], prior, table)[1]


def test_empty_table(documents):
    assert personal_data(documents().limit(0)).count() == 0
    assert [r["spans"] for r in personal_data(documents((1, "clean"))).collect()] == [""]


def test_a_hot_kind_leaves_rows_for_rare_ones(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(pii, "_fit", lambda features, target: fitted.extend(features) or np.zeros(1))
    span = lambda i, kind: dict(kind=kind, start=i, stop=i + 9, base=False, votes="yy-", features=[KINDS.index(kind)])
    rows = [(i, [span(i, "email" if i < 20 else "phone")]) for i in range(5000)]
    schema = "doc_id bigint, found array<struct<kind string, start int, stop int, base boolean, votes string, features array<int>>>"
    pii.learn(spark.createDataFrame(rows, schema), most=200)
    kinds = [KINDS[f[0]] for f in fitted]
    assert kinds.count("email") == 20 and 40 <= kinds.count("phone") <= 130
