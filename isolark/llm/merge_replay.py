"""Replay of byte-pair merges over many distinct words at once.

The words of a block lie one behind the other. An inverted index lists, for each
merge rank, the positions where its pair of tokens stands. Ranks are taken in
order from a heap; a merge is applied to all words that hold its pair, and only
the pairs left and right of the merged places are looked up anew. A word that
holds the pair several times takes the leftmost first and the others when the
rank comes up again, so a pair of lower rank that a merge creates goes first,
as in merging word by word. Words don't depend on each other, so blocks give
what one replay over the whole corpus would.
"""

from __future__ import annotations

import heapq
from itertools import chain, islice, repeat

import numpy as np

from isolark.llm.common import MEMO_BYTES, MEMO_REST, gather

NONE = np.int32(2**31 - 1)


class MergeTable:
    """Ranks of token pairs, the token that each rank makes, and the first tokens of bytes."""

    def __init__(self, pairs: dict[tuple[int, int], int], made: np.ndarray, inner: np.ndarray, final: np.ndarray):
        keys = np.fromiter(((a << 20) | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        self.keys, self.of_key = np.append(keys[order], np.int64(2**62)), np.append(ranks[order], NONE)
        self.made, self.inner, self.final = made.astype(np.int32), inner.astype(np.int32), final.astype(np.int32)
        left = np.repeat(self.inner, 256)
        #: Rank of two neighbouring bytes, the second within a word or at its end.
        self.of_bytes = np.concatenate([self.ranks(left, np.tile(self.inner, 256)), self.ranks(left, np.tile(self.final, 256))])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right  # below 0, and so unknown, where a token is -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.of_key[at], NONE)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one behind the other, and where each word's ids start (with the end)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    last = ends[lengths > 0] - 1
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    tok = np.full(n + 1, -1, np.int32)
    tok[:n] = table.inner[data]
    tok[last] = table.final[data[last]]
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    nxt[last], prv[starts[lengths > 0]], nxt[n], prv[n] = n, n, n, n
    rank = np.full(n + 1, NONE, np.int32)
    at_end = np.zeros(n, np.int32)
    at_end[last] = 1
    rank[: n - 1] = table.of_bytes[at_end[1:] * 65536 + data[:-1].astype(np.int32) * 256 + data[1:]]
    rank[last] = NONE

    index: dict[int, list[np.ndarray]] = {}

    def add(positions: np.ndarray, ranks: np.ndarray) -> list[int]:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        new, begin = [], 0
        for end in [*cuts.tolist(), len(ranks)]:
            key = int(ranks[begin])
            if key in index:
                index[key].append(positions[begin:end])
            else:
                index[key] = [positions[begin:end]]
                new.append(key)
            begin = end
        return new

    present = np.flatnonzero(rank < NONE).astype(np.int32)
    heap = add(present, rank[present]) if len(present) else []
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r, None)
        if lists is None:
            continue
        left = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left = left[rank[left] == r]
        if not len(left):
            continue
        if len(left) > 1:
            of = word[left]
            again = np.flatnonzero(of[1:] == of[:-1]) + 1
            if len(again):
                index[r] = [left[again]]
                heapq.heappush(heap, r)
                left = np.delete(left, again)
        right = nxt[left]
        after = nxt[right]
        touched = np.concatenate([left, prv[left]])
        tok[left], tok[right], rank[right] = table.made[r], -1, NONE
        nxt[left], prv[after] = after, left
        found = table.ranks(tok[touched], tok[nxt[touched]])
        rank[touched] = found
        pairs = found < NONE
        if pairs.any():
            for key in add(touched[pairs], found[pairs]):
                heapq.heappush(heap, key)
    alive = tok[:n] >= 0
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(word[alive], minlength=len(words)), out=offsets[1:])
    return tok[:n][alive], offsets


#: Words with more bytes than this are left to :func:`replay`, for a step of :func:`lockstep` looks at whole words.
SHORT = 64


def lockstep(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`replay`; all short words take their own next merge at the same time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short = (lengths <= SHORT) & (lengths > 0)
    rest = np.flatnonzero(~short)
    long_ids, long_offsets = replay([words[i] for i in rest.tolist()], table)
    number = np.flatnonzero(short)
    data = np.frombuffer(b"".join(words if len(number) == len(words) else [words[i] for i in number.tolist()]), np.uint8)
    size = lengths[number]
    tok = table.inner[data]
    ends = np.cumsum(size)
    tok[ends - 1] = table.final[data[ends - 1]]
    rank = np.full(len(tok), NONE, np.int32)
    if len(tok):
        rank[:-1] = table.ranks(tok[:-1], tok[1:])
        rank[ends - 1] = NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(number):
        starts = np.cumsum(size) - size
        least = np.minimum.reduceat(rank, starts)
        over = least == NONE
        if over.any():
            stay = np.repeat(~over, size)
            done.append((number[over], size[over], tok[~stay]))
            tok, rank = tok[stay], rank[stay]
            number, size, least = number[~over], size[~over], least[~over]
            if not len(number):
                break
        which = np.repeat(np.arange(len(number), dtype=np.int32), size)
        at = np.flatnonzero(rank == least[which])
        of = which[at]
        if len(at) > len(number):
            at = at[np.concatenate([[True], of[1:] != of[:-1]])]
        tok[at] = table.made[least]
        rank[at] = rank[at + 1]  # for its place at a word's end
        ended = at + 2 == np.cumsum(size)
        keep = np.ones(len(tok), bool)
        keep[at + 1] = False
        tok, rank = tok[keep], rank[keep]
        size -= 1
        at -= np.arange(len(at))
        inside = at[~ended]
        rank[inside] = table.ranks(tok[inside], tok[inside + 1])
        rank[at[ended]] = NONE
        behind = at[at > np.cumsum(size) - size]
        rank[behind - 1] = table.ranks(tok[behind - 1], tok[behind])
    count = np.zeros(len(words), np.int64)
    count[rest] = np.diff(long_offsets)
    for own, n, _ in done:
        count[own] = n
    offsets = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(offsets[-1], np.int32)
    for own, n, values in [*done, (rest, np.diff(long_offsets), long_ids)]:
        if len(values):
            ends = np.cumsum(n)
            ids[np.repeat(offsets[own] - (ends - n), n) + np.arange(len(values))] = values
    return ids, offsets


class Memo:
    """Token ids of chunks of text, each distinct chunk encoded once while the memo holds it.

    The memo is bounded in bytes, those of its arrays included. When it is full,
    the chunks that came first stay, which in text are the frequent ones.
    """

    #: Bytes of an entry besides its letters and ids: string, number, place in the dictionary, offset.
    ENTRY = 49 + 32 + 110 + 8

    def __init__(self, encode, limit: int = MEMO_BYTES):
        self.encode, self.limit, self.size = encode, limit, 0
        self.index: dict[str, int] = {}
        self.values, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def cost(self, chunks) -> int:
        return sum(map(len, chunks)) + self.ENTRY * len(chunks)

    def trim(self, limit: int = MEMO_REST) -> None:
        """Keep the first entries, about ``limit`` bytes of them; at the end of a task, to give memory back."""
        if self.size > limit:
            kept = len(self.index) * limit // self.size
            self.index = dict(islice(self.index.items(), kept))
            self.offsets = self.offsets[: kept + 1].copy()
            self.values = self.values[: self.offsets[-1]].copy()
            self.size = self.cost(self.index) + 4 * len(self.values)

    def places(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The number of each chunk, where it has none yet (-1), and the distinct chunks without one."""
        codes = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0)
        return codes, missing, list(dict.fromkeys(map(flat.__getitem__, missing.tolist())))

    def __call__(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other and how many each text has."""
        flat = list(chain.from_iterable(cut))
        codes, missing, fresh = self.places(flat)
        own = self.cost(fresh)
        if self.size + own > self.limit:
            self.trim(self.limit // 2)
            codes, missing, fresh = self.places(flat)
            own = self.cost(fresh)
        if fresh:
            values, offsets = self.encode(fresh)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.values = np.concatenate([self.values, values])
            self.size += own + 4 * len(values)
            codes[missing] = np.fromiter(map(self.index.__getitem__, map(flat.__getitem__, missing.tolist())), np.int64, len(missing))
        ids, lengths = gather(self.values, self.offsets, codes)
        chunks = np.fromiter(map(len, cut), np.int64, len(cut))
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(chunks)
        return ids, total[ends] - total[ends - chunks]
