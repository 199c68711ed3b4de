"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately: one on windows of ordinary
documents, one on the stretches of toxic documents whose byte n-grams stand in
many more surroundings there than in ordinary text, which leaves out what both
share and what copies repeat. A window of a text is compressed twice: with the
ordinary dictionary, and with the toxic one in front of it. What the second
saves is due to toxic content alone. The savings of all windows of a text are
summed up in a few numbers, and a logistic curve, fitted on the same learnable
rows, turns them into a score whose threshold is given.

Learned from at most ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` labelled rows, chosen
by a hash of their id, never from held-out ones.

Defined results: null and empty texts are one empty window and get its score;
without labels of both classes every score is 0; rows pass through one by one.
If a document has several labels, the highest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import blocks, held_out, learnable, learned, map_batches, texts
from isolark.llm.language import balanced

TOXIC_DOCS, ORDINARY_DOCS = 1000, 2000
#: Bytes of a window, of the dictionaries, and of an n-gram.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, GRAM = 64, 65536, 8192, 6
#: A telling n-gram has that many times the share of surroundings in toxic text, and at least so many there.
RATIO, SUPPORT = 10.0, 12
THRESHOLD = 0.3
SLOTS = 1 << 22


def written(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def grams(data: bytes) -> np.ndarray:
    """Slots of the n-grams of ``data``."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.zeros(max(0, len(a) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        h = (h ^ a[i : len(a) - GRAM + 1 + i] if len(h) else h) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h % SLOTS).astype(np.int64)


#: Slots are counted in so many turns, which bounds the driver's memory.
TURNS = 8


def surroundings(docs: list[bytes]) -> tuple[np.ndarray, int]:
    """How many different n-grams stand before each n-gram, and their sum."""
    counts, total = np.zeros(SLOTS, np.int32), 0
    for turn in range(TURNS):
        own = []
        for data in docs:
            g = grams(data)
            if len(g) > GRAM:
                here, before = g[GRAM:], g[:-GRAM]
                own.append((((here << 22) | before))[here % TURNS == turn])
        pairs = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        pairs >>= 22
        counts += np.bincount(pairs, minlength=SLOTS).astype(np.int32)
        total += len(pairs)
    return counts, max(1, total)


def stretches(data: bytes, telling: np.ndarray) -> list[bytes]:
    """The parts of ``data`` that telling n-grams cover, one byte more to the left."""
    at = np.flatnonzero(telling[grams(data)])
    if not len(at):
        return []
    return [data[max(0, int(g[0]) - 1) : int(g[-1]) + GRAM + 1] for g in np.split(at, np.flatnonzero(np.diff(at) > 3) + 1)]


def windows(data: bytes) -> list[bytes]:
    """``data`` cut behind blanks where there is one in the second half of a window; never nothing."""
    out, start, n = [], 0, len(data)
    while n - start > WINDOW:
        blank = data.rfind(b" ", start + WINDOW // 2, start + WINDOW)
        end = blank if blank > 0 else start + WINDOW
        out.append(data[start:end])
        start = end
    out.append(data[start:])
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of ``samples``; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        ),
    )


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.opened = None

    def __getstate__(self):
        return self.__dict__ | {"opened": None}

    def savings(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if self.opened is None:
            self.opened = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        plain, both = self.opened[0].compress, self.opened[1].compress
        return np.array([len(plain(w)) - len(both(w)) for w in windows(written(text))], float)

    def features(self, text: str) -> np.ndarray:
        s = self.savings(text)
        top = np.sort(s)[-3:]
        many = s >= 4
        return np.array([np.log1p(np.maximum(s, 0).sum()), s.mean(), top.mean(), top[-1], many.mean(), np.log1p(many.sum()), np.log1p(len(s)), 1.0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-((self.features(text) - self.mean) / self.spread) @ self.weights)))


def calibrate(model: Model, rows: list[tuple[str, int]], weight: np.ndarray, penalty: float = 1e-3) -> Model:
    """Logistic regression of the labels on the features by Newton steps; ``weight`` undoes how the sample was drawn."""
    x, y = np.array([model.features(t) for t, _ in rows]), np.array([v for _, v in rows], float)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.mean[-1], model.spread[-1] = 0, 1
    z, w = (x - model.mean) / model.spread, np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (p * (1 - p) * weight)) @ z + penalty * np.eye(len(w)), z.T @ ((p - y) * weight) + penalty * w)
    model.weights = w
    return model


def train(rows: list[tuple[str, int]], shares: dict[int, float] | None = None) -> Model | None:
    """Learn from (text, label) rows; ``shares``: the part of all rows of a label that the sample holds."""
    by_label = {v: [written(t) for t, label in rows if label == v and t] for v in (0, 1)}
    if not all(by_label.values()):
        return None
    counts, totals = zip(*(surroundings(by_label[v]) for v in (0, 1)), strict=True)
    telling = counts[1] >= SUPPORT
    some = np.flatnonzero(telling)
    telling[some] = (counts[1][some] + 0.5) / totals[1] > RATIO * (counts[0][some] + 0.5) / totals[0]
    del counts
    rng = np.random.default_rng(5)
    plain = [w for d in by_label[0] for w in windows(d)]
    # What tells toxic text apart stands in ordinary text by chance too; its dictionary must not hold it.
    plain = [w for w in (plain[i] for i in rng.permutation(len(plain))[:20_000]) if not telling[grams(w)].any()]
    toxic = [s for d in by_label[1] for s in stretches(d, telling)]
    model = Model(trained(plain, ORDINARY_BYTES), trained(toxic, TOXIC_BYTES))
    weight = np.array([1 / (shares or {}).get(v, 1.0) for _, v in rows])
    return calibrate(model, rows, weight)


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows to learn from."""
    return labels.where(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> Model | None:
    known = known_labels(labels)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = {v: min(1.0, wanted / counts[v]) for v, wanted in ((0, ordinary_docs), (1, toxic_docs)) if counts.get(v)}
    if len(shares) < 2:
        return None
    # The labels are drawn first, so no texts but the drawn ones are moved.
    drawn = balanced(known.where("label = 1"), "label", toxic_docs, toxic_docs).union(balanced(known.where("label = 0"), "label", ordinary_docs, ordinary_docs))
    ids = {r["doc_id"]: r["label"] for r in drawn.collect()}
    sample = texts(docs, "doc_id").where(F.col("doc_id").isin(list(ids)))
    return learned(sample, lambda rows: train([(text, ids[doc_id]) for doc_id, text in rows], shares), "doc_id", "text")


def _score(model: Model | None, threshold: float):
    def run(batches):
        for batch in batches:
            for part, block in blocks(batch):
                scores = [model.score(t) if model else 0.0 for t in block]
                names = [n for n in part.schema.names if n != "text"]
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    source = texts(docs.withColumn("held_out", held_out()), "doc_id", "held_out")
    return map_batches(source, _score(model, threshold), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def _clean(model: Model | None, threshold: float):
    def run(batches):
        for batch in batches:
            for part, block in blocks(batch):
                keep = [model is None or model.score(t) < threshold for t in block]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all columns."""
    from isolark.llm.byte_bpe import schema_of

    return map_batches(docs, _clean(model, threshold), schema_of(docs))
