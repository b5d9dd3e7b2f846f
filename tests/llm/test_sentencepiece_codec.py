import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from flowlens.llm.packing import vocabulary
from flowlens.llm.sentencepiece_codec import BPE, UNIGRAM, Codec, decode, encode, round_trip

TEXTS = [
    "Hello world", "  two   spaces ", "", "日本語 テキスト 🙂 naïve\n\ttab", "a▁b", "x" * 3000, "\x00nul \x00", "<unk> <s> <0x41>",
    "á é ﬁ ½", " ", "   ", "the same the same", "ünïcode " * 50,
]


def model_file(folder, kind, **normaliser):
    """A small model written by hand: characters, some pieces with scores, and bytes."""
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = True
    for name, value in {"name": "identity", "add_dummy_prefix": True, "remove_extra_whitespaces": False, **normaliser}.items():
        setattr(model.normalizer_spec, name, value)
    for piece, type_ in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0, type=type_)
    for b in range(256):
        model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    pieces = ["▁the", "▁s", "am", "ame", "same", "▁same", "he", "th", "▁t", "▁th", "ll", "llo", "Hello", "▁w", "or", "wor", "ld", "world"]
    for i, piece in enumerate([*pieces, "▁", *"abcdefghijklmnopqrstuvwxyzH<>0x41"]):
        if piece not in {p.piece for p in model.pieces}:
            model.pieces.add(piece=piece, score=-1.0 - 0.37 * i, type=1)
    path = folder / f"model-{kind}-{len(normaliser)}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.fixture(scope="module", params=["public", "bpe", "unigram", "unigram-trimmed", "bpe-bare"])
def path(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    return {
        "public": lambda: vocabulary("piece_bpe_32k.model"),
        "bpe": lambda: model_file(folder, BPE),
        "unigram": lambda: model_file(folder, UNIGRAM),
        "unigram-trimmed": lambda: model_file(folder, UNIGRAM, remove_extra_whitespaces=True),
        "bpe-bare": lambda: model_file(folder, BPE, add_dummy_prefix=False),
    }[request.param]()


def test_ids_and_texts_equal_the_reference(path):
    own, reference = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ends, same, _ = own.encode(pa.array([*TEXTS, None]))
    rows = [r.tolist() for r in np.split(ids, ends[:-1])]
    assert rows == [reference.encode(t) for t in [*TEXTS, ""]]
    assert same.all()
    assert own.decode(rows) == [reference.decode(r) for r in rows]


def test_a_wrong_tokenizer_is_noticed(path):
    class Swapped:
        """Gives the ids of every stretch in reverse."""

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            found = self.tokenizer.encode_batch_fast(texts, **options)
            return [type("Ids", (), {"ids": e.ids[::-1]}) for e in found]

        def decode_batch(self, ids, **options):
            return self.tokenizer.decode_batch(ids, **options)

    own = Codec(path)
    own.tokenizer = Swapped(own.tokenizer)
    _, _, same, read = own.encode(pa.array(["Hello unbelievable worlds", ""]))
    assert same.tolist() == read.tolist() == [False, True]


def test_whole_texts_are_decoded(path):
    """Before, only distinct stretches were, in no order."""

    class Forgetful:
        """Decodes no more than 20 pieces of a list."""

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def decode_batch(self, ids, **options):
            return self.tokenizer.decode_batch([row[:20] for row in ids], **options)

    own = Codec(path)
    own.tokenizer = Forgetful(own.tokenizer)
    _, _, same, read = own.encode(pa.array(["the same " * 30, "the same"]))
    assert (same.tolist(), read.tolist()) == ([True, True], [False, True])


def test_a_wrong_normaliser_is_noticed(path, monkeypatch):
    """The reference gets the text as it came; before, it got what our own normaliser made of it."""
    monkeypatch.setattr(Codec, "normalise", lambda self, text, right=Codec.normalise: right(self, text.lower()))
    _, _, same, _ = Codec(path).encode(pa.array(["Hello world", "the same"]))
    assert same.tolist() == [False, True]


def test_rows(documents):
    path = vocabulary("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(TEXTS), (None, "no id"), (50, None), (0, TEXTS[0])]
    frame = documents(*rows)
    coded = encode(frame, path)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in coded.collect()) == sorted((i or -1, reference.encode(t or "")) for i, t in rows)
    back = {r["doc_id"]: r["text"] for r in decode(coded, path).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}
    for r in round_trip(frame, path).collect():
        ids = np.array(reference.encode(dict(rows)[r["doc_id"]] or ""), "<u4")
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes())) and r["parity"]
        assert r["text_matches"] or "▁" in dict(rows)[r["doc_id"]]


def test_empty_table(documents):
    assert round_trip(documents().limit(0), vocabulary("piece_bpe_32k.model")).count() == 0
