"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A text is cut before single blanks, where the pattern always starts a new match;
distinct chunks are matched by the pattern once, and the distinct matches of a
block are merged together by :mod:`merge_replay`. A match that is itself a token
is taken whole, as the tokenizer's library does. Nothing is shuffled.

Defined results: null and empty texts have no ids and decode to nothing; all
other columns named in ``keep`` pass through, rows stay as they are.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import blocks, gather, map_batches, texts
from isolark.llm.merge_replay import Memo, MergeTable, replay

#: A blank between white space, or behind it at the end: then blanks don't start matches and the text stays whole.
INNER_BLANK = re.compile(r"\s \s|\s \Z")
#: Marks the chunk that starts a text and so has no blank before it; a lone surrogate can't stand in a text.
FIRST = "\ud800"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> MergeTable:
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                pairs[a, b] = rank
    single = np.array([ranks[bytes([b])] for b in range(256)])
    return MergeTable(pairs, np.arange(max(ranks.values()) + 1), single, single)


class Encoder:
    def __init__(self, ranks_file: str, pattern: str):
        self.ranks = read_ranks(ranks_file)
        self.table = merge_table(self.ranks)
        # The tokenizer's \s is the Unicode property, which unlike Python's has no separators U+001C to U+001F.
        self.match = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo = Memo(self.encode_chunks)

    def chunks(self, text: str) -> list[str]:
        if INNER_BLANK.search(text):
            return [FIRST + text]
        parts = text.split(" ")
        if parts[0] == "" and len(parts) > 1:
            del parts[0]  # the first blank belongs to the next chunk
        else:
            parts[0] = FIRST + parts[0]
        return parts

    def matches(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """Matches of all chunks one behind the other, and how many each has.

        Chunks without inner white space are matched in one go: between them
        stands a line feed, which then always is a match of its own.
        """
        written = [c[1:] if c[:1] == FIRST else " " + c for c in chunks]
        plain = [c.split() == [c] for c in chunks]
        joined = self.match("\n".join(w for w, p in zip(written, plain, strict=True) if p))
        flat, counts, at, n = [], [], 0, len(joined)
        for w, p in zip(written, plain, strict=True):
            if p:
                try:
                    end = joined.index("\n", at)
                except ValueError:
                    end = n
                own = joined[at:end]
                at = end + 1
            else:
                own = self.match(w)
            flat += own
            counts.append(len(own))
        return flat, counts

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = self.matches(chunks)
        place = dict.fromkeys(flat)
        distinct = [m.encode() for m in place]
        whole = np.fromiter((self.ranks.get(b, -1) for b in distinct), np.int32, len(distinct))
        ids, offsets = replay([b for b, w in zip(distinct, whole.tolist(), strict=True) if w < 0], self.table)
        # Matches that are tokens themselves stand behind the merged ones.
        where = np.empty(len(distinct), np.int64)
        where[whole < 0] = np.arange(len(offsets) - 1)
        where[whole >= 0] = len(offsets) - 1 + np.arange((whole >= 0).sum())
        place = dict(zip(place, where.tolist(), strict=True))
        ids = np.concatenate([ids, whole[whole >= 0]])
        offsets = np.concatenate([offsets, offsets[-1] + np.arange(1, (whole >= 0).sum() + 1)])
        values, lengths = gather(ids, offsets, np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return values, np.concatenate([[0], total[np.cumsum(counts)]])

    def __call__(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.memo([self.chunks(t) if t else [] for t in batch])


@lru_cache(1)
def encoder_of(ranks_file: str, pattern: str) -> Encoder:
    """Tasks that follow each other in one Python worker share the memo."""
    return Encoder(ranks_file, pattern)


def _encode(ranks_file: str, pattern: str):
    def run(batches):
        encoder = encoder_of(ranks_file, pattern)
        try:
            for batch in batches:
                for part, block in blocks(batch):
                    ids, counts = encoder(block)
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    kept = [part.column(name) for name in part.schema.names if name != "text"]
                    names = [name for name in part.schema.names if name != "text"]
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], [*names, "ids"])
        finally:
            encoder.memo.trim()

    return run


def _decode(ranks_file: str):
    def run(batches):
        tokens = sorted((rank, token) for token, rank in read_ranks(ranks_file).items())
        data = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        offsets = np.zeros(tokens[-1][0] + 2, np.int64)
        for rank, token in tokens:
            offsets[rank + 1] = len(token)
        offsets = np.cumsum(offsets)
        for batch in batches:
            rows = max(1, batch.num_rows * 1_000_000 // max(1, len(batch.column("ids").flatten())))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column("ids")
                values, lengths = gather(data, offsets, ids.flatten().to_numpy(zero_copy_only=False))
                total = np.concatenate([[0], np.cumsum(lengths)])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
                cuts = pa.py_buffer(total[ends].astype(np.int32).tobytes())
                binary = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, cuts, pa.py_buffer(np.ascontiguousarray(values).tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, binary], [*part.schema.names, "decoded"])

    return run


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, ranks_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``, the token ids of the whole text."""
    source = texts(docs, *keep)
    return map_batches(source, _encode(ranks_file, pattern), f"{schema_of(source.drop('text'))}, ids array<int>")


def decode(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """All columns and ``decoded``, the bytes that ``ids`` stand for."""
    return map_batches(encoded, _decode(ranks_file), f"{schema_of(encoded)}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
