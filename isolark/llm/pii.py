"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions.

The base spans follow four fixed forms. The tagger is trained in numpy on
windows of a bounded sample of documents whose base spans are the labels. A
text is read in overlapping windows; where windows overlap, the scores of a
place are averaged by its distance from their edges, and one Viterbi pass over
the whole joined stretch decides all its labels together. A span of the model
counts if no base span touches it and if it holds what its kind can't do
without: an at sign, or a digit. So windows without a digit and an at sign
can't give a span, and are not scored.

Defined results: null and empty texts have no spans; spans are in code points
with the end exclusive; rows pass through one by one, repeated ones included.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import blocks, code_points, map_batches, texts
from isolark.llm.secrets import SCHEMA, span_column
from isolark.llm.tagger import Tagger, char_numbers

# The kinds in their order and the forms of the base spans.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile("[0-9@]")

WINDOW, STRIDE = 64, 32
#: Documents and windows that the tagger is trained on, and its steps.
SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS = 3000, 6000, 240
#: Least mean lead of a span's label over "outside" in the scores.
LEAD = 2.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str):
    """Leftmost non-overlapping matches of the address form, found from the at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and at >= end and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end), each kind leftmost and not overlapping itself."""
    if not SIGN.search(text):
        return []
    spans = [(start, 0, "email", end) for start, end in emails(text)]
    spans += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, "card", m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return sorted(spans)


def window_starts(points: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign."""
    places = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
    if not len(places):
        return places
    last = places // STRIDE
    starts = np.unique(np.concatenate([last, np.maximum(last - 1, 0)]))
    return starts * STRIDE


def windows(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    numbers = np.concatenate([char_numbers(points), np.zeros(WINDOW, np.int32)])
    return numbers[starts[:, None] + np.arange(WINDOW)]


def gold_labels(n: int, spans: list[tuple[int, int, str, int]]) -> np.ndarray:
    """Label 0 outside; 1 + 2 * kind at a span's start and 2 + 2 * kind inside. Earlier kinds win where spans overlap."""
    labels = np.zeros(n + WINDOW, np.int64)
    for start, kind, _, end in sorted(spans, key=lambda s: -s[1]):
        labels[start:end] = 2 + 2 * kind
        labels[start] = 1 + 2 * kind
    return labels


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, limit: int = SAMPLE_WINDOWS, steps: int = STEPS) -> Tagger:
    """Train on the windows of at most ``sample`` documents with digits or at signs, chosen by a hash, ``limit`` windows at most."""
    source = texts(docs, "doc_id").where(F.col("text").rlike("[0-9@]"))
    numbers, gold, count = [], [], 0
    drawn = [r[0] for r in source.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample).collect()]  # before any text is moved
    rows = source.where(F.col("doc_id").isin(drawn)).select("text", "doc_id").toLocalIterator()
    for (text, _) in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text)):
        points = code_points(text)
        starts = window_starts(points)
        labels = gold_labels(len(points), base_spans(text))
        numbers.append(windows(points, starts))
        gold.append(labels[starts[:, None] + np.arange(WINDOW)])
        count += len(starts)
        if count >= limit:
            break
    tagger = Tagger(1 + 2 * len(KINDS))
    if count:
        tagger.train(np.concatenate(numbers)[:limit], np.concatenate(gold)[:limit], steps)
    return tagger


def joined_scores(scores: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(start, scores) of the stretches that windows of one text cover; overlaps are averaged by the distance from the windows' edges."""
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    out, begin = [], 0
    for end in [*(np.flatnonzero(np.diff(starts) > WINDOW) + 1).tolist(), len(starts)]:
        first = int(starts[begin])
        size = int(starts[end - 1]) - first + WINDOW
        total, weights = np.zeros((size, scores.shape[2]), np.float32), np.zeros((size, 1), np.float32)
        for i in range(begin, end):
            at = int(starts[i]) - first
            total[at : at + WINDOW] += scores[i] * weight
            weights[at : at + WINDOW] += weight
        out.append((first, total / weights))
        begin = end
    return out


def tagged_spans(tagger: Tagger, block: list[str]) -> list[list[tuple[int, int, str, int]]]:
    """The model's spans of each text."""
    points = [code_points(t) for t in block]
    starts = [window_starts(p) for p in points]
    found: list[list] = [[] for _ in block]
    owners = [i for i, s in enumerate(starts) if len(s)]
    stretches: list[tuple[int, int, np.ndarray]] = []
    at, pending = 0, []
    while at < len(owners):  # texts together until their windows fill a batch
        pending, size = [], 0
        while at < len(owners) and (not pending or size + len(starts[owners[at]]) <= 2048):
            pending.append(owners[at])
            size += len(starts[owners[at]])
            at += 1
        for i, scores in zip(pending, np.split(_scores(tagger, np.concatenate([windows(points[i], starts[i]) for i in pending])), np.cumsum([len(starts[i]) for i in pending])[:-1]), strict=True):
            stretches += [(i, first, s) for first, s in joined_scores(scores, starts[i])]
    stretches.sort(key=lambda s: len(s[2]))
    for at in range(0, len(stretches), 256):
        group = stretches[at : at + 256]
        lengths = np.array([len(s) for _, _, s in group])
        padded = np.zeros((len(group), lengths.max(), tagger.labels), np.float32)
        for row, (_, _, s) in zip(padded, group, strict=True):
            row[: len(s)] = s
        for labels, (i, first, s) in zip(tagger.decode(padded, lengths), group, strict=True):
            found[i] += [(first + a, kind, KINDS[kind], first + b) for a, b, kind in spans_of(labels[: len(s)], s)]
    return [sorted(f) for f in found]


def _scores(tagger: Tagger, numbers: np.ndarray) -> np.ndarray:
    return np.concatenate([tagger.emissions(numbers[i : i + 512]) for i in range(0, len(numbers), 512)])


def spans_of(labels: np.ndarray, scores: np.ndarray):
    """(start, end, kind) of the runs of one kind whose scores lead those of "outside" enough."""
    kinds = (labels.astype(np.int64) + 1) // 2
    begins = (kinds > 0) & ((labels % 2 == 1) | (np.concatenate([[0], kinds[:-1]]) != kinds))
    for a in np.flatnonzero(begins).tolist():
        b = a + 1
        while b < len(labels) and kinds[b] == kinds[a] and not begins[b]:
            b += 1
        if (scores[np.arange(a, b), labels[a:b]] - scores[a:b, 0]).mean() >= LEAD:
            yield a, b, int(kinds[a]) - 1


def added(text: str, base: list[tuple[int, int, str, int]], model: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """The model's spans inside the text that no base span touches and that hold what their kind needs."""
    starts, ends = [s[0] for s in base], list(accumulate((s[3] for s in base), max))
    out = []
    for start, order, kind, end in model:
        end = min(end, len(text))
        before = bisect_left(starts, end)
        own = text[start:end]
        if (before and ends[before - 1] > start) or not (("@" in own) if kind == "email" else any("0" <= c <= "9" for c in own)):
            continue
        out.append((start, order, kind, end))
    return out


def _scan(tagger: Tagger):
    def run(batches):
        for batch in batches:
            for part, block in blocks(batch):
                base = [base_spans(t) for t in block]
                model = tagged_spans(tagger, block)
                more = [added(t, b, m) for t, b, m in zip(block, base, model, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), span_column(base, more)], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end, base)."""
    source = texts(docs, "doc_id")
    return map_batches(source, _scan(tagger), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
