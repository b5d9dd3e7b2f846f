"""Encoding and decoding of SentencePiece models by the tokenizers library.

The model's protobuf is parsed and its parts are set up anew: the normaliser, the mark for spaces,
the pieces with their scores (unigram models) or the merges that the scores stand for (BPE models),
and byte fallback. Whether the result is the same is checked, not assumed: the reference library
encodes every whole text as it came, and `parity` tells whether its ids are ours. The ids of every
text are decoded as a whole, too. No id is taken over from another text.

Defined results: a NULL text counts as empty and has no ids. Texts that hold a NUL or a space mark
of their own, rows without doc_id and repeated rows are treated like others. An empty table gives
no rows. `text_matches` compares the decoded text with the normalised one.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm import workers
from flowlens.llm.tables import texts
from flowlens.llm.word_cache import slices

MARK = "▁"
UNIGRAM, BPE = 1, 2  # model types of the protobuf
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # types of a piece
HOPELESS = -1e6


def parse_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def build_tokenizer(model):
    """A tokenizers.Tokenizer of the model. It takes text whose spaces are marked already."""
    from tokenizers import AddedToken, Tokenizer, models

    pieces = [p.piece for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
    fallback = model.trainer_spec.byte_fallback
    if model.trainer_spec.model_type == UNIGRAM:
        # Pieces that stand for no text must not match any. Bytes keep their names, which fallback
        # looks up, and get a score that loses to every other way to read '<0x41>'.
        scored = [
            (p.piece, p.score if p.type in (NORMAL, USER) else HOPELESS) if p.type in (NORMAL, USER, BYTE)
            else (f"\x00\x00{i}", HOPELESS)
            for i, p in enumerate(model.pieces)
        ]
        core = models.Unigram(scored, unk_id=unknown, byte_fallback=fallback)
    elif model.trainer_spec.model_type == BPE:
        # The pair whose union has the best score is merged first; a piece may be reached by several.
        place = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        merges = [
            (-model.pieces[i].score, place[whole[:cut]], place[whole[cut:]], whole[:cut], whole[cut:])
            for whole, i in place.items()
            for cut in range(1, len(whole))
            if whole[:cut] in place and whole[cut:] in place
        ]
        ranked = [(left, right) for *_, left, right in sorted(merges)]
        core = models.BPE(
            {p: i for i, p in enumerate(pieces)}, ranked, unk_token=pieces[unknown], fuse_unk=True, byte_fallback=fallback
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    own = [AddedToken(p.piece, normalized=False) for p in model.pieces if p.type == USER]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class Codec:
    """Encodes and decodes batches of texts by one model file."""

    def __init__(self, path: str):
        # a task has the cores Spark gave it; more threads only wait for each other
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        import sentencepiece
        from tokenizers import decoders, normalizers

        self.model = parse_model(path)
        self.spec = spec = self.model.normalizer_spec
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer = build_tokenizer(self.model)
        self.tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.charsmap = normalizers.Precompiled(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        pieces = self.model.pieces
        self.kinds = {i: p.type for i, p in enumerate(pieces) if p.type in (UNKNOWN, CONTROL, BYTE)}
        first = f"<0x{MARK.encode()[0]:02X}>"  # bytes may spell a mark, which then is no space
        self.odd = {i for i, k in self.kinds.items() if k != BYTE or pieces[i].piece == first}

    def normalise(self, text: str) -> str:
        """As the model's normaliser has it: character map, extra spaces, marks, one mark in front."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.spec.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if text and self.spec.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.spec.escape_whitespaces else text

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids, whether the reference gives the whole text the same
        ids, whether the ids of the whole text decode to the normalised one)"""
        given = [t or "" for t in column.to_pylist()]
        normal = [self.normalise(t) for t in given]
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]
        same = [ours == theirs for ours, theirs in zip(rows, self.reference.encode(given, num_threads=1))]
        plain = (n.replace(MARK, " ") for n in normal)
        read = [self._unfronted(p) == t for p, t in zip(plain, self.decode(rows))]
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(rows), "<u4", int(ends[-1]) if len(ends) else 0)
        return ids, ends, np.array(same, bool), np.array(read, bool)

    def _unfronted(self, text: str) -> str:
        """Without the space that encoding puts in front."""
        return text[1:] if self.spec.add_dummy_prefix and text.startswith(" ") else text

    def _by_runs(self, row: list[int]) -> str:
        """The text of ids of which some are no usual pieces."""
        sign, parts = self.model.trainer_spec.unk_surface or " \u2047 ", []
        for kind, run in groupby(row, lambda i: self.kinds.get(i, NORMAL)):
            if kind == UNKNOWN:
                parts += [sign for _ in run]
            elif kind != CONTROL:
                text = self.tokenizer.decode(list(run), skip_special_tokens=False)
                parts.append(text if kind == BYTE else text.replace(MARK, " "))
        return "".join(parts)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids, without the space that encoding puts in front. Unknown pieces read
        as the model's own sign for them, control pieces as nothing."""
        found = zip(self.tokenizer.decode_batch(ids, skip_special_tokens=False), ids)
        texts = (t.replace(MARK, " ") if self.odd.isdisjoint(row) else self._by_runs(row) for t, row in found)
        return [self._unfronted(t) for t in texts]


def codec(path: str) -> Codec:
    return workers.model(("codec", path), lambda: Codec(path))


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            ids, ends, same, _ = codec(path).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, ends), pa.array(same)], ["doc_id", "ids", "parity"])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, parity) per document."""
    return texts(documents).mapInArrow(_encoded(path), "doc_id bigint, ids array<int>, parity boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codec(path).decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    ids = rows.select(rows["doc_id"].cast("bigint").alias("doc_id"), rows["ids"].cast("array<int>").alias("ids"))
    return ids.mapInArrow(_decoded(path), "doc_id bigint, text string")


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in (s for b in batches for s in slices(b, "text")):
            ids, ends, same, read = own.encode(batch.column("text"))
            rows = np.split(ids.astype("<u4"), ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array(same),
                    pa.array(read),
                ],
                ["doc_id", "n_ids", "ids_crc32", "parity", "text_matches"],
            )

    return run


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), parity,
    text_matches."""
    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, parity boolean, text_matches boolean"
    return texts(documents).mapInArrow(_digested(path), schema)
