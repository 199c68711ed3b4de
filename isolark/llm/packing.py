"""Packing of token streams into windows by the sum-of-squares rule.

Each task tokenises its documents and packs them as they come. Full windows are
cut off a document first; the rest goes where the sum over all fill levels of
the squared number of open windows becomes smallest, which the level array
gives in one vector step. Nothing is shuffled and no window spans tasks.

Open windows are held in memory, so their number is bounded by ``open_limit``:
beyond it, and at the end of a task, the emptiest windows are poured into the
fullest, cutting pieces where needed. What is left at last fills windows whose
lengths are powers of two, which need no padding.

Defined results: a null or empty text is one end token; ids of documents may be
null or repeated, each row is packed on its own; extra columns are ignored. An
empty table gives no pieces.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import blocks, gather, map_batches, texts
from isolark.llm.merge_replay import Memo, MergeTable, lockstep

WINDOW = 2048
END_ID = 1
#: Open windows that a task holds (2 KB to 8 KB each).
OPEN_LIMIT = 2048
#: Letters from here on, and special strings, are left to the library.
FIRST_EXOTIC = "ɐ"


def small(text: str) -> str:
    """``text`` in small letters, if it is of Latin-1 letters alone: the tokenizer makes them small anyhow, and fewer chunks differ."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class WordTokenizer:
    """Ids as the tokenizer's library gives them, each distinct chunk between blanks encoded once.

    Blanks are dropped by the tokenizer and no merge spans them. Chunks are
    normalised and matched as the tokenizer's file says; chunks with letters
    beyond the Latin blocks go to the library itself, and so do texts that hold
    a special string.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file) as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        pairs = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        # Bytes are written as the printable Latin letter they are, or else as the next free one from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        inner, final = (np.array([vocab[letters[b] + end] for b in range(256)]) for end in ("", suffix))
        self.table = MergeTable(pairs, np.array([vocab[a + b] for a, b in merges]), inner, final)
        self.match = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        self.memo = Memo(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        exotic = [not c.isascii() and max(c) >= FIRST_EXOTIC for c in chunks]
        # Below the exotic letters there is nothing to compose, and none whose small form depends on its neighbours.
        plain = [c.lower() for c, e in zip(chunks, exotic, strict=True) if not e]
        flat, counts = [], []
        for c in plain:
            own = [c] if c.isalpha() else self.match(c)
            flat += own
            counts.append(len(own))
        place = dict(zip(dict.fromkeys(flat), range(len(flat)), strict=False))
        ids, offsets = lockstep([w.encode() for w in place], self.table)
        values, lengths = gather(ids, offsets, np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)))
        total = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.diff(total[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])
        if not any(exotic):
            return values, np.concatenate([[0], np.cumsum(sizes)])
        other = [e.ids for e in self.library.encode_batch([c for c, e in zip(chunks, exotic, strict=True) if e], add_special_tokens=False)]
        whole = np.concatenate([[0], np.cumsum(np.concatenate([sizes, [len(o) for o in other]]))]).astype(np.int64)
        values = np.concatenate([values, np.array([i for o in other for i in o], np.int32)])
        mask = np.array(exotic)
        at = np.empty(len(chunks), np.int64)
        at[~mask], at[mask] = np.arange(len(plain)), len(plain) + np.arange(len(other))
        values, lengths = gather(values, whole, at)
        return values, np.concatenate([[0], np.cumsum(lengths)])

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        special = [any(s in t for s in self.special) for t in batch]
        values, counts = self.memo([[] if s or not t else small(t).split(" ") for t, s in zip(batch, special, strict=True)])
        out = np.split(values, np.cumsum(counts)[:-1]) if batch else []
        for i in np.flatnonzero(special):
            out[i] = np.array(self.library.encode(batch[i], add_special_tokens=False).ids, np.int32)
        return out


@lru_cache(1)
def tokenizer_of(file: str) -> WordTokenizer:
    """Tasks that follow each other in one Python worker share the memo."""
    return WordTokenizer(file)


class Packer:
    """Windows of one task. A piece is [doc_id, start, ids, doc_tokens]; finished windows go to ``rows``."""

    def __init__(self, window: int, open_limit: int, first_sequence: int):
        self.window, self.open_limit, self.sequence = window, open_limit, first_sequence
        self.level = np.zeros(window + 1, np.int64)  # open windows at each fill
        self.at_level: dict[int, list[list]] = {}
        self.open = 0
        self.rows: list[tuple] = []

    def finish(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def best_level(self, size: int) -> int:
        """Fill level (0: a new window) at which ``size`` more tokens leave the smallest sum of squares."""
        n = self.level
        change = 2 * n[size : self.window + 1] + 1  # a window more at the level reached
        change[-1] = 0  # full windows don't count
        change[1:] -= 2 * n[1 : self.window - size + 1] - 1  # a window less at the level left
        change[1:][n[1 : self.window - size + 1] == 0] = np.iinfo(np.int64).max
        return int(change.argmin())

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, cut = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, cut, self.window):
            self.finish([[doc_id, start, ids[start : start + self.window], total]])
        if cut == total:
            return
        size, piece = total - cut, [doc_id, cut, ids[cut:], total]
        fill = self.best_level(size)
        pieces = []
        if fill:
            pieces = self.at_level[fill].pop()
            self.level[fill] -= 1
            self.open -= 1
        pieces.append(piece)
        if fill + size == self.window:
            self.finish(pieces)
            return
        self.at_level.setdefault(fill + size, []).append(pieces)
        self.level[fill + size] += 1
        self.open += 1
        if self.open > self.open_limit:
            self.pour(self.open_limit // 2)

    def pour(self, keep: int) -> None:
        """Fill the fullest windows from the emptiest until ``keep`` are open; with 0, close all."""
        fills = [(fill, pieces) for fill in sorted(self.at_level) for pieces in self.at_level[fill]]
        low, high = 0, len(fills) - 1
        source = fills[0][1] if fills else []
        while high - low + 1 > max(keep, 1):
            fill, target = fills[high]
            while fill < self.window and low < high:
                doc_id, start, ids, total = source.pop()
                taken = min(len(ids), self.window - fill)
                # The tail goes over, so what stays behind keeps its place.
                target.append([doc_id, start + len(ids) - taken, ids[len(ids) - taken :], total])
                if taken < len(ids):
                    source.append([doc_id, start, ids[: len(ids) - taken], total])
                fill += taken
                if not source:
                    low += 1
                    source = fills[low][1]
            if fill < self.window:
                break
            self.finish(target)
            high -= 1
        rest = [pieces for _, pieces in fills[low : high + 1] if pieces]
        self.level[:] = 0
        self.at_level, self.open = {}, len(rest)
        if not keep:
            for pieces in rest:
                self.powers(pieces)
            self.open = 0
            return
        for pieces in rest:
            fill = sum(len(p[2]) for p in pieces)
            self.at_level.setdefault(fill, []).append(pieces)
            self.level[fill] += 1

    def powers(self, pieces: list) -> None:
        """Windows whose lengths are the powers of two that add up to the tokens of ``pieces``."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            own, room = [], size
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                taken = min(room, len(ids))
                own.append([doc_id, start, ids[:taken], total])
                if taken < len(ids):
                    pieces.insert(0, [doc_id, start + taken, ids[taken:], total])
                room -= taken
            self.finish(own)
            left -= size

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(file: str, window: int, end_id: int, open_limit: int):
    def emit(rows):
        for at in range(0, len(rows), 2000):
            columns = list(zip(*rows[at : at + 2000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ARROW, strict=True)], schema=ARROW)

    def run(batches):
        tokenize = tokenizer_of(file)
        packer = Packer(window, open_limit, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.int32)
        try:
            for batch in batches:
                for part, block in blocks(batch):
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenize(block), strict=True):
                        packer.add(doc_id, np.concatenate([ids, end]))
                    yield from emit(packer.drain())
        finally:
            tokenize.memo.trim()
        packer.pour(0)
        yield from emit(packer.drain())

    return run


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, open_limit: int = OPEN_LIMIT) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit numbers."""
    return map_batches(texts(docs, F.col("doc_id").cast("long").alias("doc_id")), _pack(tokenizer_file, window, end_id, open_limit), SCHEMA)
