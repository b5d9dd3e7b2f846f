import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowlens.llm.packing import concatenate_and_cut, tokenised, vocabulary

ROWS = [
    (1, "Hello, WORLD! it's 42 o'clock"), (2, None), (3, ""), (4, " \t\n"), (5, "a" * 4000), (6, "word " * 3000),
    (7, "naïve ΣΑΣ İstanbul é x y z <|endoftext|> don't"), (None, "no id"), (8, "same"), (8, "same"),
    (9, "don'\tt 's\x0b's … ½ ①"),
    (10, "(Hello), “quoted” Ünïcödé-STRASSE; ß… àÀÿ×÷ e\u0301 x\u0301y <|end|> a|b [x] {y} ~z~ l'été 3rd A1b ﬁ ª º"),
]


def brute_ids(text):
    tokenizer = Tokenizer.from_file(vocabulary())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizer(documents):
    for row in tokenised(documents(*ROWS), vocabulary()).collect():
        texts = [t for i, t in ROWS if i == row["doc_id"]]
        got = np.frombuffer(row["ids"], f"<u{row['width']}").tolist()
        assert got == brute_ids(texts[0]) and row["doc_tokens"] == len(got)


@pytest.mark.parametrize("length", [16, 4096])
def test_pieces_cover_every_id_once(documents, length):
    got = concatenate_and_cut(documents(*ROWS).repartition(3), length=length).collect()
    total = sum(len(brute_ids(t)) for _, t in ROWS)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for number, pieces in by_sequence.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == min(length, total - number * length)
    for doc_id, text in dict(ROWS).items():
        ids = np.array(brute_ids(text), "<u4")
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc_id)
        copies = sum(i == doc_id for i, _ in ROWS)
        assert sum(p[1] for p in pieces) == copies * len(ids)
        for start, n, crc in pieces:
            assert crc == zlib.crc32(ids[start : start + n].tobytes())
        if copies == 1:
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]


def test_padding(documents):
    last = max(concatenate_and_cut(documents((1, "one two three")), length=8).collect(), key=lambda r: r["sequence_id"])
    assert (last["length"], last["padded_length"]) == (4, 4)
    last = concatenate_and_cut(documents((1, "one two")), length=8).collect()[0]
    assert (last["length"], last["padded_length"]) == (3, 8)


def test_empty_table(documents):
    assert concatenate_and_cut(documents().limit(0)).count() == 0
