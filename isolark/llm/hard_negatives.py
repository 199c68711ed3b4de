"""Hard negatives by a matrix product in a residue number system.

Vectors become integers, floor(256 x). A tile multiplies the matrices of
residues modulo several small primes, each product exact in float32, and puts
the signed scores together again by Chinese remaindering (mixed radix digits).
The primes are as large as the length of the vectors allows, and as many as the
largest product of two norms in the table needs, so every score is exact.

Rows are packed in blocks and every block of anchors meets every block of rows
by a join on dense block numbers. The first pass keeps the best rows of the
anchor's label, the second one forms the tiles again and keeps, for each
positive, the best rows of other labels inside its window of scores. Both keep
a few rows per tile and anchor; a ranked window, which Spark trims before the
shuffle, takes the best of all tiles.

Defined results: rows with a null label, id or vector, or with a null or
non-finite component take no part, zero and empty vectors do; vectors meet those
of their own length only; other columns, whatever their names, are ignored; ties
go to the smaller id; an id that several rows carry asks once, with the smallest
of its (label, vector), rows of the anchor's id are none of its candidates, and
repeated candidates are found as often as they stand in the table; anchors
without positives or without rows in a window give no rows, nor does an empty
table. Scores that could exceed a long raise an error before any tile is formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isolark.llm.common import Scratch, everywhere, map_batches

#: Rows in a block of candidates and of anchors, and anchors of a tile that are scored at once.
ROWS, ANCHORS, SLICE = 4096, 1024, 128
#: Components that one float32 product takes at once.
DEPTH = 1024
NONE = np.iinfo(np.int64).min


def primes_below(limit: int) -> list[int]:
    sieve = np.ones(limit, bool)
    sieve[:2] = False
    for i in range(2, int(limit**0.5) + 1):
        sieve[i * i :: i] = False
    return np.flatnonzero(sieve)[::-1].tolist()


class Residues:
    """Exact signed products of integer matrices whose scores don't exceed ``bound``."""

    def __init__(self, dim: int, bound: int):
        # Residues lie within (p - 1) / 2 of zero, so that DEPTH products of two add up to less than 2 ** 24.
        half = int((2**24 / max(1, min(dim, DEPTH))) ** 0.5) - 1
        known, self.primes, product = primes_below(min(2 * half + 1, 4096)), [], 1
        for i, p in enumerate(known):
            if product > 2 * bound:
                break
            if product * p > 2 * bound:  # the last one, no larger than it has to be
                p = min(q for q in known[i:] if product * q > 2 * bound)
            self.primes.append(p)
            product *= p
        self.product = product
        if product <= 2 * bound or product >= 2**63:
            raise ValueError("scores of these vectors don't fit the residue number system")
        #: Inverse of each earlier prime modulo each prime.
        self.inverse = [[pow(q, -1, p) for q in self.primes[:i]] for i, p in enumerate(self.primes)]

    def residues(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for p in self.primes:
            r = np.mod(rows, p)
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        digits: list[np.ndarray] = []
        # Sums of a few products fit 32 bits; a difference of floors is quicker than a remainder.
        kind = np.int32 if not left or left[0].shape[1] <= 64 * DEPTH else np.int64
        for i, p in enumerate(self.primes):
            a, b = left[i], right[i]
            digit = np.zeros((len(a), len(b)), kind)
            for at in range(0, a.shape[1], DEPTH):
                digit += (a[:, at : at + DEPTH] @ b[:, at : at + DEPTH].T).astype(kind)
            digit -= digit // kind(p) * kind(p)
            for earlier, inverse in zip(digits, self.inverse[i], strict=True):
                digit -= earlier
                digit -= digit // kind(p) * kind(p)
                digit *= kind(inverse)
                digit -= digit // kind(p) * kind(p)
            digits.append(digit)
        total = np.zeros(digits[0].shape, np.int64) if digits else np.zeros((0, 0), np.int64)
        for p, digit in zip(reversed(self.primes), reversed(digits), strict=True):
            total *= p
            total += digit
        # The upper half stands for negative scores: a mask from the sign bit takes the product off there.
        total -= (self.product // 2 - total) >> 63 & self.product
        return total


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label and ``vector`` (integers) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", relabelled.alias("label"), F.transform("v", lambda x: F.floor(x * 256.0)).alias("vector"), F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256.0).cast("double"), 2)).alias("square"))


def _pack(size: int):
    """Rows of one task as blocks of one length of vectors; a block is numbered within its task."""

    def run(batches):
        task, turn, held = TaskContext.get().partitionId(), 0, {}

        def out(dim):
            nonlocal turn
            rows = held.pop(dim)
            packed = [np.array([r[i] for r in rows], "<i8").tobytes() for i in (0, 1)]
            turn += 1
            columns = [[task], [turn - 1], [dim], *([p] for p in packed), [np.array([r[2] for r in rows], "<i8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["task", "turn", "dim", "ids", "labels", "vectors"])

        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            for vec_id, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                held.setdefault(len(v), []).append((vec_id, label, v))
                if len(held[len(v)]) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def packed(rows: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """One row per block, written so that the numbers stay; ``block`` counts them from 0 without gaps."""
    written = scratch.keep(map_batches(rows, _pack(size), "task int, turn long, dim int, ids binary, labels binary, vectors binary"))
    # One row per task that wrote blocks goes through this window.
    per_task = written.groupBy("task").agg(F.count(F.lit(1)).alias("own"))
    first = per_task.select("task", (F.sum("own").over(Window.orderBy("task")) - F.col("own")).alias("first"))
    return written.join(first, "task").withColumn("block", F.col("first") + F.col("turn")).drop("task", "turn", "first")


def best_columns(scores: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest entries per row that aren't NONE; of equal ones the first columns."""
    n, width = scores.shape
    if bound < 2**62 // max(1, width):  # one key holds score and place
        keys = np.where(scores == NONE, NONE, scores * width + (width - 1 - np.arange(width)))
        at = np.argpartition(keys, width - k, axis=1)[:, width - k :] if k < width else np.tile(np.arange(width), (n, 1))
    else:
        at = np.argsort(scores, axis=1, kind="stable")
        flipped = np.argsort(scores[:, ::-1], axis=1, kind="stable")  # ties: the first columns last
        at = width - 1 - flipped[:, max(0, width - k) :]
    row = np.repeat(np.arange(n), at.shape[1])
    column = at.ravel()
    found = scores[row, column] != NONE
    return row[found], column[found]


class Ranked:
    """The ``k`` largest entries of a row within a window, for many windows: rows are ordered once, ties with the first columns last."""

    def __init__(self, scores: np.ndarray, k: int, bound: int):
        self.scores, self.k, self.bound = scores, k, bound
        self.width = scores.shape[1]
        self.keys = None
        if bound < 2**61 // max(1, self.width):  # one key holds score and place
            self.keys = np.sort(np.where(scores == NONE, NONE, scores * self.width + (self.width - 1 - np.arange(self.width))), axis=1)

    def between(self, rows: np.ndarray, least: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``rows`` and column of the best entries of each within ``least`` and ``largest``."""
        if self.keys is None:
            seen = self.scores[rows]
            return best_columns(np.where((seen >= least[:, None]) & (seen <= largest[:, None]), seen, NONE), self.k, self.bound)
        # No score lies outside the bound, so neither need the ends of a window.
        low, high = (np.clip(x, -self.bound - 1, self.bound + 1) for x in (least, largest))
        end = np.array([np.searchsorted(self.keys[r], (h + 1) * self.width) for r, h in zip(rows.tolist(), high.tolist(), strict=True)], np.int64)
        at = end[:, None] - 1 - np.arange(self.k)
        keys = np.where(at >= 0, self.keys[rows[:, None], np.maximum(at, 0)], NONE)
        i, j = np.nonzero((keys != NONE) & (keys >= low[:, None] * self.width))
        return i, self.width - 1 - keys[i, j] % self.width


def _tile(row: dict, bound: int):
    """Slices of a tile: (anchor range, scores, labels differ, is another id, ids), candidates by id."""
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    order = np.argsort(ids, kind="stable")
    dim = row["dim"]
    system = Residues(dim, bound)
    right = system.residues(np.frombuffer(row["vectors"], "<i8").reshape(len(ids), dim)[order])
    ids, labels = ids[order], labels[order]
    asked, own = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["a_labels"], "<i8")
    queries = np.frombuffer(row["a_vectors"], "<i8").reshape(len(asked), dim)
    for at in range(0, len(asked), SLICE):
        part = slice(at, at + SLICE)
        scores = system.scores(system.residues(queries[part]), right)
        yield part, scores, own[part, None] != labels[None, :], asked[part, None] != ids[None, :], ids


def _positives(k: int, bound: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asked = np.frombuffer(row["a_ids"], "<i8")
                for part, scores, differs, other, ids in _tile(row, bound):
                    np.copyto(scores, NONE, where=differs | ~other)
                    i, j = best_columns(scores, k, bound)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[part][i]), pa.array(ids[j]), pa.array(scores[i, j])], ["anchor_id", "positive_id", "positive_score"])

    return run


def window_of(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score in hundredths ``low`` to ``high`` of positive scores, without overflow."""
    q, r = np.divmod(scores, 100)
    return q * low + -(-r * low // 100), q * high + r * high // 100


def _negatives(k: int, low: int, high: int, bound: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asked = np.frombuffer(row["a_ids"], "<i8")
                counts = np.frombuffer(row["counts"], "<i8")
                positives, reached = (np.frombuffer(row[c], "<i8") for c in ("positives", "reached"))
                least, largest = window_of(reached, low, high)
                starts = np.concatenate([[0], np.cumsum(counts)])
                for part, scores, differs, other, ids in _tile(row, bound):
                    np.copyto(scores, NONE, where=~(differs & other))
                    ranked = Ranked(scores, k, bound)
                    for turn in range(int(counts[part].max(initial=0))):
                        own = np.flatnonzero(counts[part] > turn)
                        at = starts[:-1][part][own] + turn
                        i, j = ranked.between(own, least[at], largest[at])
                        columns = [asked[part][own[i]], positives[at[i]], np.full(len(i), turn, np.int32), ids[j], reached[at[i]], scores[own[i], j]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "turn", "negative_id", "positive_score", "negative_score"])

    return run


def _windows(batches):
    """Anchors of a block with their positives behind each other, as packed columns."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            flat = [p for ps in row["found"] for p in ps]
            numbers = [[len(ps) for ps in row["found"]], [p["positive_id"] for p in flat], [p["positive_score"] for p in flat]]
            out.append([row["dim"], *(np.array(row[c], "<i8").tobytes() for c in ("ids", "labels")), np.array(row["vectors"], "<i8").tobytes(), *(np.array(n, "<i8").tobytes() for n in numbers)])
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["dim", "a_ids", "a_labels", "a_vectors", "counts", "positives", "reached"])


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    scratch = Scratch()
    rows = usable(embeddings)
    blocks = scratch.keep(packed(rows.drop("square"), ROWS, scratch))
    bound = int((rows.agg(F.max("square")).first()[0] or 0.0) * (1 + 1e-9)) + 1
    if bound >= 2**62:
        raise ValueError("scores of these vectors don't fit a long")
    count = max(1, blocks.count())
    asked = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select("vec_id", "own.label", "own.vector")
    anchors = scratch.keep(asked)

    sent = packed(anchors, ANCHORS, scratch).select("dim", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"))
    near = map_batches(everywhere(blocks, sent, count), _positives(positives, bound), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    found = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("found"))

    # Anchors with positives, dealt anew in blocks of a size that doesn't depend on who has some.
    chosen = scratch.keep(anchors.join(found, "vec_id"))
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-chosen.count() // (ANCHORS // 2)))))
    grouped = chosen.groupBy(F.size("vector").alias("dim"), dealt.alias("_deal")).agg(F.collect_list(F.struct("vec_id", "label", "vector", "found")).alias("rows"))
    lists = grouped.select("dim", *(F.col(f"rows.{a}").alias(b) for a, b in (("vec_id", "ids"), ("label", "labels"), ("vector", "vectors"), ("found", "found"))))
    windows = map_batches(lists, _windows, "dim int, a_ids binary, a_labels binary, a_vectors binary, counts binary, positives binary, reached binary")
    far = map_batches(everywhere(blocks, scratch.keep(windows), count), _negatives(negatives, low, high, bound), "anchor_id long, positive_id long, turn int, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "turn").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
