import random

import numpy as np
import pytest

from flowlens.llm.language_id import UNKNOWN, codewords, identify, keep_identified

SOUNDS = {
    "de": "sch ein und keit lich ung der zu auf ö".split(),
    "en": "the ing th ou and er ly of sh tion".split(),
    "fr": "eau oux que le é ment oi ai re ç".split(),
    "es": "ción os ado la ñ ará el y do mente".split(),
    "fi": "kä yö lla ssa nen ää uu hto ksi mme".split(),
    "pl": "szcz ów nie ął prz wie rz ść owa ych".split(),
}


def written(lang, words, seed):
    dice = random.Random(seed)
    return " ".join("".join(dice.choice(SOUNDS[lang]) for _ in range(dice.randint(1, 3))) for _ in range(words))


def corpus(languages, each):
    return [(i, written(lang, 30, i), lang) for i, lang in enumerate(sorted(languages) * each)]


@pytest.mark.parametrize("languages", [["en", "fr"], ["de", "en", "fr", "es"], list(SOUNDS)])
def test_held_out_accuracy(documents, languages):
    rows = corpus(languages, 60)
    got = {r["doc_id"]: r for r in identify(documents(*rows)).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    right = sum(got[i]["lang_pred"] == rows[i][2] for i in held)
    assert len(held) > 20 and right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_special_rows(documents):
    rows = corpus(["en", "fr"], 40)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? \x00", "fr"), (None, written("fr", 40, 1), "en"),
           (1003, written("en", 150_000, 2), None), (1004, written("en", 20, 3), None), (1004, written("en", 20, 3), None)]
    got = identify(documents(*rows, *odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == (UNKNOWN, 0.0) for i in (1000, 1001, 1002))
    assert (by_id[None]["lang_pred"], by_id[None]["held_out"]) == ("fr", False)
    assert by_id[1003]["lang_pred"] == by_id[1004]["lang_pred"] == "en"
    frame = documents(*rows, *odd)
    kept = keep_identified(frame)
    assert kept.schema == frame.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got} - {1000, 1001, 1002}


def test_mixed_text_is_ambiguous(documents):
    rows = corpus(["en", "fr"], 40)
    mixed = [" ".join(w for pair in zip(written("en", 200, s).split(), written("fr", 200, s).split()) for w in pair) for s in range(20)]
    got = identify(documents(*rows, *((2000 + i, t, None) for i, t in enumerate(mixed)))).collect()
    pure = [r["score"] for r in got if r["doc_id"] < 2000]
    mixed_scores = [r["score"] for r in got if r["doc_id"] >= 2000]
    assert np.median(mixed_scores) < np.quantile(pure, 0.05)


def test_nothing_to_learn_from(documents):
    frame = documents((1, "some text", None), (2, None, "en"))
    assert {(r["lang_pred"], r["score"]) for r in identify(frame).collect()} == {(UNKNOWN, 0.0)}
    assert keep_identified(frame).count() == 2
    assert identify(documents().limit(0)).count() == 0
    one = identify(documents((1, "some text", "en"), (3, "other text", "en"), (4, "9", "en"))).collect()
    assert {r["lang_pred"] for r in one} == {"en", UNKNOWN}


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 6, 40])
def test_codewords_are_distinct(classes):
    code = codewords(classes)
    assert len(np.unique(code, axis=0)) == classes
    assert all(len(set(column)) == 2 for column in code.T)
