"""Secret scans: fixed patterns, and two character Markov models.

The base spans follow three fixed forms. Beyond them, words of key letters are
judged by the log-likelihood ratio per letter of two first-order Markov models
of characters: one of random strings, learned from the secrets that the base
forms find in a bounded sample of documents, and one of ordinary identifiers,
learned from the other words of the same sample. Long random words that no base
span touches become spans of kind ``random``.

Defined results: null and empty texts have no spans and stay null or empty; spans are in code points
with the end exclusive; rows pass through one by one, repeated ones included.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import blocks, code_points, learned, map_batches, runs, texts

# The kinds in their order, and the least lengths.
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")

#: Letters of the models; every other character is one more, 64.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
IN_WORD = np.zeros(129, bool)
IN_WORD[[ord(c) for c in ALPHABET + "_=-"]] = True
#: Least length of a random word.
LEAST_WORD = 20
#: Documents that the models are learned from.
SAMPLE_DOCS = 4000
#: Least mean log-likelihood ratio per letter of a random word, and the kinds of letters that it mixes at least.
THRESHOLD, MIXED = 1.5, 2

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end), each kind leftmost and not overlapping itself."""
    spans = []
    lower = text.translate(LOWER) if not text.isascii() else text.lower()
    places = set()
    for word in KEYWORDS:
        at = lower.find(word)
        while at >= 0:
            places.add(at)
            at = lower.find(word, at + 1)
    end = 0
    for at in sorted(places):
        if at >= end and (m := ASSIGN.match(text, at)):
            end = m.end()
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                spans.append((at, 0, "assign", end))
    spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    points = code_points(text)
    starts, ends = runs(((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 102)))
    long = ends - starts >= LEAST["hex"]
    spans += [(int(a), 2, "hex", int(b)) for a, b in zip(starts[long], ends[long], strict=True)]
    return sorted(spans)


CODE = np.full(128, 64, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(64)


def coded(word: str) -> np.ndarray:
    points = code_points(word)
    return np.where(points < 128, CODE[np.minimum(points, 127)], 64)


class Markov:
    """First-order model of characters with add-one smoothing; state 65 is the start."""

    def __init__(self):
        self.counts = np.ones((66, 65))

    def learn(self, words: list[str]) -> None:
        for w in words:
            c = coded(w)
            np.add.at(self.counts, (np.concatenate([[65], c[:-1]]), c), 1)

    def logs(self) -> np.ndarray:
        return np.log(self.counts / self.counts.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> np.ndarray:
    """Log-likelihood ratio of each pair of letters, from at most ``sample`` documents chosen by a hash of their id.

    Secrets are few, so half of the sample are documents in which a base form may stand.
    """
    hint = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    source = texts(docs, "doc_id")
    order = F.xxhash64("doc_id")
    # Ids are drawn before any text is moved.
    drawn = source.where(F.col("text").rlike(hint)).select("doc_id").orderBy(order).limit(sample // 2).union(source.select("doc_id").orderBy(order).limit(sample - sample // 2))
    rows = source.where(F.col("doc_id").isin([r[0] for r in drawn.distinct().collect()])).select("text")
    return learned(rows, ratio_of, "text")


def ratio_of(rows: Iterable[tuple[str]]) -> np.ndarray:
    """The log-likelihood ratio that the secrets and the other words of ``rows`` give."""
    random, ordinary = Markov(), Markov()
    for (text,) in rows:
        spans = base_spans(text)
        secrets, kept, at = [], [], 0
        for start, _, kind, end in spans:
            value = ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]
            secrets.append(value)
            kept.append(text[at:start])
            at = max(at, end)
        random.learn(secrets)
        ordinary.learn(re.findall(r"[A-Za-z_][A-Za-z0-9_]{3,}", " ".join([*kept, text[at:]])))
    return random.logs() - ordinary.logs()


def score(word: str, ratio: np.ndarray) -> float:
    c = coded(word)
    return float(ratio[np.concatenate([[65], c[:-1]]), c].mean())


def added_spans(text: str, base: list[tuple[int, int, str, int]], ratio: np.ndarray, threshold: float) -> list[tuple[int, int, str, int]]:
    starts, ends = runs(IN_WORD[np.minimum(code_points(text), 128)])
    base_starts, base_ends = [s[0] for s in base], list(accumulate((s[3] for s in base), max))
    found = []
    for at in np.flatnonzero(ends - starts >= LEAST_WORD).tolist():
        start, end = int(starts[at]), int(ends[at])
        before = bisect_left(base_starts, end)
        if before and base_ends[before - 1] > start:
            continue
        word = text[start:end]
        if sum(bool(re.search(c, word)) for c in ("[A-Z]", "[a-z]", "[0-9]")) >= MIXED and score(word, ratio) >= threshold:
            found.append((start, 3, "random", end))
    return found


SCHEMA = "spans array<struct<kind: string, start: int, end: int, base: boolean>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def span_column(base: list[list[tuple[int, int, str, int]]], added: list[list[tuple[int, int, str, int]]]) -> pa.Array:
    """All spans of each text in their order; ``base`` tells those of the fixed forms from those of a model."""
    rows = [sorted([*((*s, True) for s in b), *((*s, False) for s in a)]) for b, a in zip(base, added, strict=True)]
    return pa.array([[{"kind": kind, "start": start, "end": end, "base": own} for start, _, kind, end, own in spans] for spans in rows], pa.list_(SPAN))


def redacted(text: str, spans: list[tuple[int, int, str, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _scan(ratio: np.ndarray, threshold: float, mark: str | None):
    def run(batches):
        for batch in batches:
            for part, block in blocks(batch):
                base = [base_spans(t) for t in block]
                added = [added_spans(t, b, ratio, threshold) for t, b in zip(block, base, strict=True)]
                names, columns = part.schema.names, part.columns
                if mark is None:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), span_column(base, added)], ["doc_id", "spans"])
                else:
                    absent = part.column("text").is_null().to_pylist()
                    masked = [None if a else redacted(t, sorted(b + s), mark) for a, t, b, s in zip(absent, block, base, added, strict=True)]
                    columns = [pa.array(masked, pa.string()) if n == "text" else c for n, c in zip(names, columns, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def scan(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end, base)."""
    source = texts(docs, "doc_id")
    return map_batches(source, _scan(ratio, threshold, None), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def redact(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``."""
    from isolark.llm.byte_bpe import schema_of

    return map_batches(docs, _scan(ratio, threshold, mark), schema_of(docs))


def digest(scanned: DataFrame, kinds: tuple[str, ...], base: int) -> DataFrame:
    """The contract's columns: the base spans counted by kind, the digest of the base spans, and all spans as text."""

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["base"])
    return scanned.select("doc_id", *map(count, kinds[:base]), F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
