"""Language identification by hierarchical discrimination.

Hashed character n-grams of the letters feed linear support vector machines: a
first set separates language families, then one machine for every two languages
of a family, one versus one, separates the closely related ones. The language
that wins most of its pairs is taken, the larger sum of margins on a tie. All
machines together are one weight matrix, so a text is read once and whole.

All languages of the table are learned. The sample is bounded by rows alone:
``SAMPLE`` documents are shared out evenly, ``PER_LANGUAGE`` and ``LEAST`` being
the most and the fewest of one language. Learning holds sparse counts and lays
out a few rows at a time.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if nothing could be learned; rows pass through one by one,
repeated ones and those without an id too; an empty table stays empty; a text of
any length is read whole; other columns, whatever their names, are ignored. A
language that no family of the table holds is a family of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import blocks, code_points, held_out, learnable, map_batches, texts

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
#: Documents to learn from in all, of one language at most and at least, and passes over them.
SAMPLE, PER_LANGUAGE, LEAST, EPOCHS = 12_000, 400, 20, 12
LETTER = regex.compile(r"\p{L}")
#: What a letter counts as; everything else in ASCII is a blank.
PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def balanced(docs: DataFrame, label: str, per_class: int, total: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """About ``per_class`` rows of each label, fewer if there are so many labels that they would be more than ``total``; chosen by a hash of the id."""
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}  # one number per label, which a model has to hold anyway
    if not counts:
        return docs.limit(0)
    own = max(least, min(per_class, total // len(counts)))
    share = F.create_map(*[F.lit(x) for key, n in counts.items() for x in (key, int(min(1.0, own / n) * 1_000_000))])
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.coalesce(F.element_at(share, F.col(label)), F.lit(0)))


def grams(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, sizes in rows, and the start of each text; texts stand three characters apart."""
    lower = [t.lower() for t in block]
    points = code_points("\0\0\0".join(lower) + "\0\0\0")
    points = np.where(points < 128, PLAIN[np.minimum(points, 127)], points).astype(np.uint32)
    hashed = np.zeros((len(GRAMS), len(points)), np.int32)
    for row, n in enumerate(GRAMS):
        h = np.full(len(points) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        hashed[row, : len(h)] = h % BUCKETS
    return hashed, np.concatenate([[0], np.cumsum([len(t) + 3 for t in lower])])


@dataclass
class Model:
    """Weights (buckets, machines) and biases; machines are the families and then the ``pairs`` of languages of one family."""

    families: list[str]
    languages: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, block: list[str]) -> np.ndarray:
        hashed, starts = grams(block)
        total = np.zeros((len(block), self.weights.shape[1]))
        for row in hashed:
            total += np.add.reduceat(self.weights[row], starts[:-1], axis=0)
        return total / (len(GRAMS) * np.diff(starts)[:, None]) + self.bias

    def predict(self, block: list[str]) -> list[tuple[str, float]]:
        margins = self.margins(block)
        f = len(self.families)
        of = [self.families.index(FAMILY_OF.get(x, x)) for x in self.languages]
        members = [[i for i, x in enumerate(of) if x == family] for family in range(f)]
        duels = [[(at, a, b) for at, (a, b) in enumerate(self.pairs, f) if of[a] == family] for family in range(f)]
        out = []
        for text, m in zip(block, margins.tolist(), strict=True):
            if not LETTER.search(text):
                out.append(("und", 0.0))
                continue
            family = max(range(f), key=m.__getitem__)
            won = {i: [0, 0.0, 1.0] for i in members[family]}  # pairs won, sum of margins, chance of the closest pair
            for at, a, b in duels[family]:
                for i, margin in ((a, m[at]), (b, -m[at])):
                    own = won[i]
                    won[i] = [own[0] + (margin > 0), own[1] + margin, min(own[2], 1 / (1 + exp(-2 * max(-300.0, min(300.0, margin)))))]
            best = max(won, key=lambda i: (won[i][0], won[i][1], -i))
            out.append((self.languages[best], share(np.array(m[:f]), family) * won[best][2]))
        return out


def share(margins: np.ndarray, chosen: int) -> float:
    e = np.exp(2 * (margins - margins.max()))
    return float(e[chosen] / e.sum())


class Sample:
    """Frequencies of n-grams of the texts to learn from, as sparse rows."""

    def __init__(self, sampled: list[str]):
        self.buckets, self.values = [], []
        for at in range(0, len(sampled), 200):
            block = sampled[at : at + 200]
            hashed, starts = grams(block)
            for i in range(len(block)):
                count = np.bincount(hashed[:, starts[i] : starts[i + 1]].ravel(), minlength=BUCKETS)
                own = np.flatnonzero(count)
                self.buckets.append(own.astype(np.uint16))
                self.values.append((count[own] / (len(GRAMS) * (starts[i + 1] - starts[i]))).astype(np.float32))

    def rows(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), BUCKETS), np.float32)
        for row, i in zip(out, own.tolist(), strict=True):
            row[self.buckets[i]] = self.values[i]
        return out


#: Frequencies of n-grams are small numbers; the machines see them enlarged.
SCALE = 30.0


def svm(sample: Sample, chosen: np.ndarray, y: np.ndarray, epochs: int, penalty: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Linear support vector machines over the ``chosen`` rows, one per column of ``y``, by averaged subgradient steps on the hinge loss; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1])
    mean_w, mean_b, n = np.zeros_like(w), np.zeros_like(b), 0
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y < 0).sum(axis=0))) * len(y)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            own = order[at : at + 32]
            x = sample.rows(chosen[own])
            rate = 2.0 / (1 + epoch)
            miss = ((y[own] * (SCALE * (x @ w) + b) < 1) * y[own] * weight[own]).astype(np.float32)
            w *= np.float32(1 - rate * penalty)
            w += np.float32(rate * SCALE / len(own)) * (x.T @ miss)
            b += 0.1 * rate * miss.mean(axis=0)
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += b
                n += 1
    return SCALE * mean_w / max(1, n), mean_b / max(1, n)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model | None:
    """Learn from (text, language) rows."""
    rows = [(t, lang) for t, lang in rows if LETTER.search(t)]
    if not rows:
        return None
    sample = Sample([t for t, _ in rows])
    languages = sorted({lang for _, lang in rows})
    families = sorted({FAMILY_OF.get(lang, lang) for lang in languages})
    of = [families.index(FAMILY_OF.get(lang, lang)) for lang in languages]
    number = {lang: i for i, lang in enumerate(languages)}
    spoken = np.array([number[lang] for _, lang in rows])
    own = np.array(of)[spoken]
    sides = np.where(own[:, None] == np.arange(len(families)), 1, -1)
    weights, bias = svm(sample, np.arange(len(rows)), sides, epochs) if len(families) > 1 else (np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    machines = [(weights, bias)]
    pairs = [(a, b) for b in range(len(languages)) for a in range(b) if of[a] == of[b]]
    for a, b in pairs:
        two = np.flatnonzero((spoken == a) | (spoken == b))
        machines.append(svm(sample, two, np.where(spoken[two] == a, 1, -1)[:, None], epochs))
    return Model(families, languages, pairs, np.concatenate([w for w, _ in machines], axis=1).astype(np.float32), np.concatenate([b for _, b in machines]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = SAMPLE) -> Model | None:
    """Learn from about ``per_language`` learnable documents of each language, about ``total`` in all."""
    known = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = [(r.text, r.lang) for r in balanced(known, "lang", per_language, total).select("text", "lang", "doc_id").toLocalIterator()]
    return train(sorted(rows))


def _predict(model: Model | None):
    def run(batches):
        for batch in batches:
            for part, block in blocks(batch, limit=500_000):
                found = model.predict(block) if model else [("und", 0.0)] * len(block)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    source = texts(docs.withColumn("held_out", held_out()), "doc_id", "held_out")
    return map_batches(source, _predict(model), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
