"""BPE encoding and decoding of words held as contiguous rank arrays.

A word is a row of parts with a boundary between every two neighbours; beside
each boundary stands the rank of the merge across it. The least rank of a row is
found by scanning the row, its boundary is deleted, and the ranks of the
boundaries left and right of it are looked up anew, until no boundary has a
rank. All short words of one length are rows of one array, so a step serves all
of them; they stay in step, for each step deletes one boundary of every row.
Words of more than ``SHORT`` bytes, where scanning a row for every merge would
take quadratic time, go to the linked positions of :mod:`merge_replay`.

A text is cut at special strings and before single blanks inside it, where the
pattern always starts a new word; each distinct chunk is encoded once while the
worker remembers it. Chunks with letters beyond the Latin blocks are cut into
words by the tokenizer's library. Nothing is shuffled.

Defined results: null and empty texts have no ids and decode to an empty text;
special strings inside texts become their one id, as the library's default has
it; columns named in ``keep`` pass through and other columns, whatever their
names, are ignored; repeated rows and rows without an id stay as they are; an
empty table stays empty. A text of any length is encoded whole: it is cut into
chunks as a block of its own, and a chunk is bounded by the text alone. Ids that
don't form UTF-8 decode with replacement marks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.byte_bpe import schema_of
from isolark.llm.common import blocks, gather, map_batches, texts
from isolark.llm.merge_replay import NONE, Memo, MergeTable, replay

#: Words of more bytes than this don't become rows of an array.
SHORT = 48
#: Parts in an array at most.
CELLS = 1 << 20
#: Letters from here on are cut into words by the library.
FIRST_EXOTIC = "ɐ"
#: A blank that doesn't stand between two other characters.
OUTER_BLANK = re.compile(r"(?<!\S) | (?!\S)")
INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Mark chunks that stand at the start of a text and chunks that are special strings; lone surrogates can't stand in a text.
FIRST, SPECIAL = "\ud800", "\ud801"
#: The pattern that the file's pre-tokenizer stands for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[int, str]:
    """Bytes are written as the printable Latin letter they are, or else as the next free letter from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in printable else next(free)) for b in range(256)}


def merge_rows(data: np.ndarray, table: MergeTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merge all rows of ``data`` (words of one length, as bytes): (row numbers, token ids by row) by number of tokens."""
    parts = table.inner[data]
    rank = np.full(parts.shape, NONE, np.int32)  # of the boundary behind each part; none behind the last
    rank[:, :-1] = table.ranks(parts[:, :-1], parts[:, 1:])
    number, done = np.arange(len(parts)), []
    while len(number):
        row = np.arange(len(number))
        at = rank.argmin(axis=1)
        least = rank[row, at]
        over = least == NONE
        if over.any():
            done.append((number[over], parts[over]))
            number, parts, rank, at, least = number[~over], parts[~over], rank[~over], at[~over], least[~over]
            row = np.arange(len(number))
            if not len(number):
                break
        parts[row, at] = table.made[least]
        kept = np.ones(parts.shape, bool)
        kept[row, at + 1] = False
        width = parts.shape[1] - 1
        rank[row, at] = NONE
        parts, rank = parts[kept].reshape(-1, width), rank[kept].reshape(-1, width)
        before = row[at > 0]
        rank[before, at[before] - 1] = table.ranks(parts[before, at[before] - 1], parts[before, at[before]])
        behind = row[at < width - 1]
        rank[behind, at[behind]] = table.ranks(parts[behind, at[behind]], parts[behind, at[behind] + 1])
    return done


def merge_words(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one behind the other, and where each word's ids start (with the end)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    count, found = np.zeros(len(words), np.int64), []
    first, beyond = np.searchsorted(lengths[order], [1, SHORT + 1])
    at = int(first)
    while at < beyond:
        size = int(lengths[order[at]])
        end = min(int(np.searchsorted(lengths[order], size, side="right")), at + max(1, CELLS // size))
        own = order[at:end]
        data = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(-1, size)
        for rows, parts in merge_rows(data, table):
            count[own[rows]] = parts.shape[1]
            found.append((own[rows], parts))
        at = end
    long = order[beyond:]
    ids_of_long, cuts = replay([words[i] for i in long.tolist()], table)
    count[long] = np.diff(cuts)
    offsets = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(offsets[-1], np.int32)
    for own, parts in found:
        ids[offsets[own][:, None] + np.arange(parts.shape[1])] = parts
    if len(ids_of_long):
        ids[np.repeat(offsets[long] - cuts[:-1], np.diff(cuts)) + np.arange(len(ids_of_long))] = ids_of_long
    return ids, offsets


class WordEncoder:
    """Ids of texts as the tokenizer's file gives them."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        library.no_truncation()
        library.no_padding()
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        with open(file) as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda text: [text]
        letters = byte_letters()
        single = np.array([vocab[letters[b]] for b in range(256)])
        self.table = MergeTable({(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}, np.array([vocab[a + b] for a, b in merges]), single, single)
        self.match = regex.compile(WORDS).findall
        self.memo = Memo(self.encode_chunks)

    def chunks(self, text: str) -> list[str]:
        out = []
        for turn, piece in enumerate(self.cut_special(text)):
            if turn % 2:
                out.append(SPECIAL + piece)
            elif piece:
                parts = INNER_BLANK.split(piece) if OUTER_BLANK.search(piece) else piece.split(" ")
                parts[0] = FIRST + parts[0]
                out += parts
        return out

    def words(self, chunk: str) -> list[str]:
        text = chunk[1:] if chunk[0] == FIRST else " " + chunk
        if text.isascii() or max(text) < FIRST_EXOTIC:
            return self.match(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenize(text)]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [[] if c[:1] == SPECIAL else self.words(c) for c in chunks]
        place = dict(zip(dict.fromkeys(w for ws in cut for w in ws), range(sum(map(len, cut))), strict=False))
        ids, offsets = merge_words([w.encode() for w in place], self.table)
        marks = sorted({c for c in chunks if c[:1] == SPECIAL})  # each stands behind the words as one more of a single id
        place |= zip(marks, range(len(place), len(place) + len(marks)), strict=True)
        ids = np.concatenate([ids, np.array([self.special[m[1:]] for m in marks], np.int32)])
        offsets = np.concatenate([offsets, offsets[-1] + np.arange(1, len(marks) + 1)])
        cut = [[c] if c[:1] == SPECIAL else ws for c, ws in zip(chunks, cut, strict=True)]
        values, lengths = gather(ids, offsets, np.fromiter((place[w] for ws in cut for w in ws), np.int64))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return values, total[np.concatenate([[0], np.cumsum([len(ws) for ws in cut])]).astype(np.int64)]

    def __call__(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.memo([self.chunks(t) if t else [] for t in batch])


@lru_cache(1)
def encoder_of(file: str) -> WordEncoder:
    """Tasks that follow each other in one Python worker share the tables."""
    return WordEncoder(file)


def _encode(file: str):
    def run(batches):
        encoder = encoder_of(file)
        try:
            for batch in batches:
                for part, block in blocks(batch):
                    ids, counts = encoder(block)
                    cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    names = [n for n in part.schema.names if n != "text"]
                    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], [*names, "ids"])
        finally:
            encoder.memo.trim()

    return run


def token_bytes(file: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens by id, one behind the other, and where each starts (with the end)."""
    with open(file) as f:
        spec = json.load(f)
    of_letter = {letter: b for b, letter in byte_letters().items()}
    tokens = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    written = {i: bytes(map(of_letter.__getitem__, t)) if all(c in of_letter for c in t) else t.encode() for t, i in tokens.items()}
    lengths = np.array([len(written.get(i, b"")) for i in range(max(written) + 1)])
    return np.frombuffer(b"".join(written.get(i, b"") for i in range(len(lengths))), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def _decode(file: str):
    def run(batches):
        data, offsets = token_bytes(file)
        for batch in batches:
            step = max(1, batch.num_rows * 1_000_000 // max(1, len(batch.column("ids").flatten())))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                values, lengths = gather(data, offsets, part.column("ids").flatten().to_numpy(zero_copy_only=False))
                total = np.concatenate([[0], np.cumsum(lengths)])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column("ids")).to_numpy(zero_copy_only=False))]).astype(np.int64)
                raw, cuts = values.tobytes(), total[ends].tolist()
                decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.string())], [*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``, the token ids of the whole text."""
    source = texts(docs, *keep)
    return map_batches(source, _encode(file), f"{schema_of(source.drop('text'))}, ids array<int>")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """All columns and ``decoded``, the text that ``ids`` stand for."""
    return map_batches(encoded, _decode(file), f"{schema_of(encoded)}, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
