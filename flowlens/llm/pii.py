"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span
classifier trained on the outcome decides.

Four kinds of spans have an exact base definition (`base_spans`) and always stay. Looser patterns
propose further spans of the same kinds: addresses with 'at' and 'dot' written out, phone numbers
without country code, card numbers in other groupings, long internet addresses, and numbers that the
base definition loses because other digits follow them. On every candidate,
base spans included, labelers vote yes, no or nothing: the strict pattern, checksums, gazetteers of
domain ends, card issuers and numbers kept for examples, words in the context, and the characters
around. Expectation-maximisation over the counts of all vote patterns (a few hundred rows, whatever
the corpus) estimates per kind how often each labeler votes how on true and on false spans. The
resulting probabilities are the soft labels of a logistic classifier over what a span and its
surroundings look like, fitted on at most TRAIN_SPANS candidates. A proposed span is added if the
classifier gives it at least ACCEPT and it overlaps no base span.

Texts are scanned once for all candidates; only spans, votes and features are written and read again.

Defined results: a NULL text counts as empty and has no spans; the digest of no spans is that of the
empty string. Rows without doc_id and repeated rows are treated like others. Without any candidate
nothing is added.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import workers
from flowlens.llm.tables import in_small_batches, materialize, texts
from flowlens.llm.word_cache import sliced

KINDS = ("email", "ip", "card", "phone")
TRAIN_SPANS = 20_000
ACCEPT = 0.9
FEATURES = 1 << 12  # hashed features of a span
ROUNDS = 50  # of expectation-maximisation at most

# Base definitions. A look-behind starts a match at the first digit of a run, where the leftmost
# match begins anyway; possessive repetitions keep long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms
_AT = re.compile(r"\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?(?=[A-Za-z0-9])")
_SPELLED_DOMAIN = re.compile(
    r"[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}+)+"
)
_BARE_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_GROUPED_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_]|\x20{2}|\x20-\x20)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_SHORT_CARD = re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\+[0-9]{1,3}\x20?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

# Gazetteers and context words of the labelers (fixed values)
DOMAIN_ENDS = frozenset("com org net edu gov io co info biz de fr es it uk us eu nl pl ru jp cn in br ca au ch at".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "65", "35")
SAYS_YES = {
    "email": frozenset("email mail e-mail contact write address reach correo adresse courriel".split()),
    "ip": frozenset("ip host server address client login from adresse".split()),
    "card": frozenset("card visa mastercard credit debit payment pay karte tarjeta carte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact telefon teléfono whatsapp".split()),
}
SAYS_NO = frozenset("version isbn issn order invoice page chapter release build ticket serial part sku doi rfc".split())
LABELERS = ("strict", "checksum", "gazetteer", "context", "edges", "plain")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Around every '@': the run of characters before it, up to the last match, and the domain."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            last = match.end()
            found.append((start, last))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def proposed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the looser forms that overlap no base span and, of one kind, not each other."""
    found, last = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
    for kind, pattern in (("ip", _LONG_IP), ("card", _BARE_CARD), ("card", _GROUPED_CARD), ("card", _SHORT_CARD), ("phone", _LOCAL_PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    free, i, end = [], 0, -1
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[2])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= end and (i == len(taken) or taken[i][0] >= e):
            free.append((kind, s, e))
            end = e
    return free


def _before(text: str, start: int) -> list[str]:
    return re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower())[-4:]


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One character per labeler: y, n, or - for no vote."""
    span, digits = text[start:end], _digits(text[start:end])
    said = ["y" if strict else "-"]
    if kind == "card":
        said.append("y" if _luhn(digits) else "n")
        said.append("y" if digits.startswith(ISSUERS) else "n")
    elif kind == "phone":
        area = digits[-10:-7]
        said.append("y" if len(digits) >= 10 and area[:1] not in ("", "0", "1") else "n")
        said.append("n" if len(set(digits)) == 1 or digits.endswith("5550100") else "-")
    elif kind == "email":
        said.append("n" if ".." in span or span.startswith(".") else "y")
        said.append("y" if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in DOMAIN_ENDS else "n")
    else:
        said.append("n" if span.startswith("0") else "y")
        said.append("n" if span.startswith(("0.", "255.", "127.")) else "-")
    words = _before(text, start)
    said.append("y" if SAYS_YES[kind].intersection(words) else "n" if SAYS_NO.intersection(words) else "-")
    left, right = text[start - 1 : start], text[end : end + 1]
    said.append("n" if left.isalnum() or right.isalnum() or left in "=/" and left else "y")
    said.append("n" if re.fullmatch(r"(?:19|20)[0-9]{2}[./-].*", span) or digits and len(set(digits)) <= 2 else "-")
    return "".join(said)


def features(text: str, kind: str, start: int, end: int, said_by: str) -> list[int]:
    """Hashed features: shape, length, neighbours, words, and the votes of all labelers but the
    strict one, which no proposed span can have."""
    span = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", span))[:24]
    words = _before(text, start)
    following = re.findall(r"[^\W\d_][\w-]*", text[end : end + 24].lower())[:1]
    said = [
        "bias", f"shape {shape}", f"length {min(len(span) // 3, 10)}", f"digits {min(len(_digits(span)), 20)}",
        f"left {text[start - 1 : start]}", f"right {text[end : end + 1]}", *(f"word {w}" for w in words[-2:]),
        *(f"next {w}" for w in following), *(f"{name} {v}" for name, v in zip(LABELERS[1:], said_by[1:])),
    ]
    return [zlib.crc32(f"{kind} {s}".encode()) % FEATURES for s in said]


CANDIDATE = "struct<kind:string,start:bigint,stop:bigint,votes:string,features:array<int>,base:boolean>"
_CANDIDATE = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("votes", pa.string()),
         ("features", pa.list_(pa.int32())), ("base", pa.bool_())]
    )
)


def _candidates(text: str) -> list[dict]:
    base = base_spans(text)
    found = []
    for strict, spans in ((True, base), (False, proposed_spans(text, base))):
        for kind, start, stop in spans:
            said = votes(text, kind, start, stop, strict)
            hashed = features(text, kind, start, stop, said)
            found.append({"kind": kind, "start": start, "stop": stop, "votes": said, "features": hashed, "base": strict})
    return found


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        found = [_candidates(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _CANDIDATE)], ["doc_id", "found"])


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, found): per document its candidate spans with votes and features."""
    return texts(documents).mapInArrow(workers.lean(_found), f"doc_id bigint, found array<{CANDIDATE}>")


def reliabilities(patterns: dict[str, int]) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over counted vote patterns of one kind: the share of true spans, and
    P(vote | truth) as truth x labeler x (y, n, -). Starts from the majority of the votes."""
    said = sorted(patterns)
    n = np.array([patterns[s] for s in said], float)
    vote = np.array([["yn-".index(c) for c in s] for s in said])
    true = np.array([0.5 + 0.4 * np.sign(s.count("y") - s.count("n")) for s in said])
    prior, table = 0.5, np.zeros((2, vote.shape[1], 3))
    for _ in range(ROUNDS):
        prior = (n @ true + 1) / (n.sum() + 2)
        for truth, share in ((0, 1 - true), (1, true)):
            for j in range(vote.shape[1]):
                # pseudo-counts lean to labelers that are right more often than wrong
                lean = np.array([1.0, 2.0, 1.0] if truth == 0 else [2.0, 1.0, 1.0])
                count = np.bincount(vote[:, j], n * share, 3) + lean
                table[truth, j] = count / count.sum()
        before, true = true, posterior(said, prior, table)
        if np.abs(true - before).max() < 1e-6:
            break
    return float(prior), table


def posterior(said: list[str], prior: float, table: np.ndarray) -> np.ndarray:
    """Probability that spans with these votes are true."""
    vote = np.array([["yn-".index(c) for c in s] for s in said])
    log = np.log(table[:, np.arange(vote.shape[1]), vote]).sum(2) + np.log([[1 - prior], [prior]])
    return 1 / (1 + np.exp(log[0] - log[1]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # None: nothing to learn from

    def probability(self, hashed: list[int]) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[hashed].sum(), -30, 30))))


def _fit(rows: list[list[int]], soft: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by adaptive gradient steps over all rows."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, owner = np.concatenate([np.asarray(r) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    weights, squared = np.zeros(FEATURES), np.full(FEATURES, 1e-3)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[flat], len(rows)), -30, 30)))
        slope = np.bincount(flat, (p - soft)[owner], FEATURES) / len(rows) + 1e-5 * weights
        squared += slope**2
        weights -= 0.3 * slope / np.sqrt(squared)
    return weights


def _parts(counts: dict[str, int], most: float) -> dict[str, float]:
    """The part of each kind to draw for about `most` rows: all of rare kinds, the others share alike."""
    parts = {}
    for left, kind in zip(range(len(counts), 0, -1), sorted(counts, key=counts.get)):
        drawn = min(counts[kind], most / left)
        parts[kind] = drawn / counts[kind]
        most -= drawn
    return parts


def learn(found: DataFrame, most: int = TRAIN_SPANS) -> Model:
    """The span classifier, from the table of `candidates`."""
    spans = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counted: dict[str, dict[str, int]] = {}
    sorts: dict[bool, dict[str, int]] = {True: {}, False: {}}  # base and proposed spans by kind
    for r in spans.groupBy("kind", "base", "votes").count().collect():  # at most kinds x 2 x 3 ** labelers rows
        of_kind = counted.setdefault(r["kind"], {})
        of_kind[r["votes"]] = of_kind.get(r["votes"], 0) + r["count"]
        sorts[r["base"]][r["kind"]] = sorts[r["base"]].get(r["kind"], 0) + r["count"]
    total = sum(sum(c.values()) for c in counted.values())
    if total == 0:
        return Model(None)
    soft = {}
    for kind, patterns in counted.items():
        prior, table = reliabilities(patterns)
        soft.update(zip(((kind, s) for s in patterns), posterior(list(patterns), prior, table)))
    # Drawn evenly from spans of either sort: base ones may outnumber the others a thousand to one.
    # Within a sort kinds share alike, so that a frequent one leaves rows for the rare ones.
    draw = F.pmod(F.xxhash64("doc_id", "kind", "start"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for base, kinds in sorts.items():
        for kind, part in _parts(kinds, most / 2).items():
            share = F.when((F.col("base") == base) & (F.col("kind") == kind), part).otherwise(share)
    rows = spans.where(draw < share).select("kind", "votes", "features").toArrow().to_pylist()
    if not rows:
        return Model(None)
    return Model(_fit([r["features"] for r in rows], np.array([soft[r["kind"], r["votes"]] for r in rows])))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def _decided(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in batches:
            counts, bases, everything = [], [], []
            for cell in batch.column("found"):
                spans = cell.as_py() or []
                base = [(c["kind"], c["start"], c["stop"]) for c in spans if c["base"]]
                added = [
                    (c["kind"], c["start"], c["stop"])
                    for c in spans if not c["base"] and model.probability(c["features"]) >= ACCEPT
                ]
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS] + [len(added)])
                bases.append(_said(base))
                everything.append(_said(base + added))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS) + 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(bases, pa.string()), pa.array(everything, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"],
            )

    return workers.lean(run)


def personal_data(documents: DataFrame, most: int = TRAIN_SPANS) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans."""
    found = materialize(candidates(documents))
    held = documents.sparkSession.sparkContext.broadcast(pickle.dumps(learn(found, most)))
    counts = ", ".join(f"n_{k} bigint" for k in (*KINDS, "added"))
    rows = found.mapInArrow(_decided(held), f"doc_id bigint, {counts}, base string, spans string")
    return rows.select(
        "doc_id", *(f"n_{k}" for k in (*KINDS, "added")), F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def redacted(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    found = sorted(
        (c["start"], c["stop"], c["kind"]) for c in _candidates(text)
        if c["base"] or model.probability(c["features"]) >= ACCEPT
    )
    if not found:
        return text
    out, at = [], 0
    for start, stop, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def _redacting(held, column: int, counted: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in sliced(batches, column):
            old = batch.column(column).to_pylist()
            new = [t if t is None else redacted(t, model) for t in old]
            columns = list(batch.columns)
            columns[column] = pa.array(new, batch.schema.field(column).type)
            if counted is not None:
                sizes = batch.column(counted).to_pylist()
                sizes = [len(b) if a != b else n for a, b, n in zip(old, new, sizes)]
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return workers.lean(run)


def redact(documents: DataFrame, most: int = TRAIN_SPANS) -> DataFrame:
    """The documents with personal data blanked in `text`, and `n_chars` where that changes it."""
    model = learn(materialize(candidates(documents)), most)
    held = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = [c.lower() for c in documents.columns]
    counted = names.index("n_chars") if "n_chars" in names else None
    return in_small_batches(documents).mapInArrow(_redacting(held, names.index("text"), counted), documents.schema)
