"""The prefix trie, the rank-array encoder and the hard negatives against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from isolark.llm import hard_negatives, prefix_trie, radix_tree, rank_array

# ---------------------------------------------------------------- prefix trie


def plain_trie(rows):
    """Rows (conv_id, turn, role, text) -> the contract's columns, straight from its words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            ident = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, ident), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    nodes = defaultdict(lambda: {"members": [], "ends": []})
    for c, turns in own.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]]["members"].append(c)
        nodes[path]["ends"].append(c)
    below = defaultdict(list)
    for path in nodes:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    children = defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    out = []
    for path, x in nodes.items():
        saved = sum((len(nodes[p]["members"]) - 1) * len(p[-1][1].encode()) for p in below[path] if p)
        ends = hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()
        parent = min(nodes[path[:-1]]["members"]) if path else None
        out.append((min(x["members"]), len(path), parent, len(x["members"]), children[path], sum(1 for p in below[path] if not children[p]), saved, ends))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,limit", [(1, prefix_trie.UNIT), (2, 7), (3, 1), (4, 40)])
def test_trie_equals_plain(spark, seed, limit):
    rng = random.Random(seed)
    texts = ["", "a", "ab", "é" * 3, None, "x" * 50_000]
    rows = []
    for c in rng.sample(range(-12, 60), 45):
        turn_numbers = [rng.choice([None, 0, 1, 2, 3, 7]) for _ in range(rng.randint(1, 14))]
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in turn_numbers]
    rows += rows[:5] + [(None, 1, "user", "lost")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "base": F.lit("x"), "node": F.lit(2)})
    assert trie_rows(prefix_trie.trie(df, limit)) == plain_trie(rows)


def test_trie_hot_beginning_and_long_conversation(spark):
    rows = [(c, t, "user", "hello" if t < 2 else f"{c}-{t}") for c in range(0, 200) for t in range(3)]
    rows += [(1001, t, "user", f"turn {t % 17}") for t in range(250)]
    got = trie_rows(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), 500))
    assert got == plain_trie(rows)


def test_trie_of_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_layouts_grow_and_keep_order():
    for width in (1, 2, 3):
        rng, root, keys = random.Random(width), radix_tree.Node(b""), set()
        for turn in range(3000):
            key = bytes(rng.randrange(256) if rng.random() < 0.7 else 7 for _ in range(width * rng.randrange(4)))
            radix_tree.insert(root, key, turn)
            keys.add(key)
        prefixes = {k[: i * width] for k in keys for i in range(len(k) // width + 1)}
        path, seen = [], []
        for depth, own, ends, inner in radix_tree.aligned(root, width):
            path[max(0, depth - 1) :] = [own] if depth else []
            whole = b"".join(path)
            seen.append(whole)
            assert bool(ends) == (whole in keys)
            assert inner == any(p != whole and p.startswith(whole) for p in prefixes)
        assert seen == sorted(prefixes)
    assert isinstance(root.children, radix_tree.Full)


# ---------------------------------------------------------------- rank arrays

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def awkward_texts():
    rng = random.Random(5)
    pool = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "'s", "'ll", "don't", "\u0085", "\xa0", "\x1c", "日本語", "é", "😀", "ab", "A", "12", "٣", "%%", "Ƀ", "ʰ", "word", "stochastic" * 6, "\r\n", "_"]
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(600)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(15))) for _ in range(400)]
    return [*out, "", None, " " * 90, "a" * 5000, "<|endoftext|>" * 3, *out[:5]]


def test_ranks_equal_the_library(spark, library):
    texts = awkward_texts()
    ids = [None, *range(len(texts) - 1)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    got = sorted((tuple(r) for r in rank_array.digests(rank_array.decode(rank_array.encode(df, FILE), FILE)).collect()), key=str)
    want = []
    for doc_id, text in zip(ids, texts, strict=True):
        own = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(own, skip_special_tokens=False)
        want.append((doc_id, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_ranks_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rank_array.digests(rank_array.decode(rank_array.encode(df, FILE), FILE)).collect() == []


def test_decode_of_ids_that_form_no_text(spark, library):
    rng = random.Random(3)
    rows = [[rng.randrange(50257) for _ in range(rng.randrange(6))] for _ in range(200)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in rank_array.decode(df, FILE).collect()}
    assert got == {i: library.decode(r, skip_special_tokens=False) for i, r in enumerate(rows)}


def test_short_and_long_words_agree():
    encoder = rank_array.WordEncoder(FILE)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 90))).encode() for _ in range(300)]
    ids, offsets = rank_array.merge_words(words, encoder.table)
    whole, cuts = rank_array.replay(words, encoder.table)
    assert ids.tolist() == whole.tolist() and offsets.tolist() == cuts.tolist()


# ------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    part = []
    for vec_id, e, label in rows:
        if vec_id is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        part.append((vec_id, label, tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in e)))
    anchors = {}
    for vec_id, label, e in part:
        if vec_id % 50 == 0:
            anchors[vec_id] = min(anchors.get(vec_id, (label, e)), (label, e))
    out = []
    for a, (own, e) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(e, v, strict=True)), i, l) for i, l, v in part if i != a and len(v) == len(e)]
        best = sorted((s, i) for s, i, l in scored if l == own)[:5]
        for s, p in best:
            inside = sorted((n, i) for n, i, l in scored if l != own and 50 * -s <= 100 * -n <= 95 * -s)[:3]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(inside)]
    return sorted(out)


def mined(df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize("scale", [1.0, 300.0, 2e5])
def test_negatives_equal_plain(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng = np.random.default_rng(int(scale))
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(220):
        v = centres[i % 4] + rng.normal(size=6) * 0.6
        v = np.round(v, 1) if i % 3 else v
        rows.append((i, [float(np.float32(x * scale)) for x in v], int(rng.integers(4))))
    rows += rows[10:14] + [(300, [0.0] * 6, 1), (350, [], 2), (351, [], 2), (352, [], 3), (400, [1.0, 2.0], 1), (401, [1.0, 2.5], 1), (402, [1.0, 1.5], 2)]
    rows += [(None, [1.0] * 6, 1), (1, None, 1), (2, [float("nan")] * 6, 1), (3, [None] * 6, 1), (4, [float("inf")] * 6, 2), (450, [1.0] * 6, None), (50, [9.0 * scale] * 6, 3)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"block": F.lit("x"), "dim": F.lit(1), "vector": F.lit(2)})
    got = mined(df)
    assert got and got == plain_negatives(rows)


def test_negatives_of_copies_and_empty_table(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(120)] + [(i, [0.4, 0.2], 7) for i in range(120, 400)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows)
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(50, [1e12, 1.0], 1), (51, [1e12, 1.0], 1)], VECTORS)
    with pytest.raises(ValueError):
        hard_negatives.mine(df, F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("dim,size", [(1, 2**30), (7, 1000), (64, 2**20), (1500, 90_000)])
def test_residue_products_are_exact(dim, size):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-size, size, (9, dim)) for _ in range(2))
    bound = int(max((a.astype(float) ** 2).sum(1).max(), (b.astype(float) ** 2).sum(1).max())) + 1
    system = hard_negatives.Residues(dim, bound)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert system.scores(system.residues(a), system.residues(b)).tolist() == want


def test_best_columns_by_key_and_by_sort_agree():
    rng = np.random.default_rng(2)
    scores = rng.integers(-3, 4, (40, 23))
    scores[rng.random(scores.shape) < 0.4] = hard_negatives.NONE
    found = []
    for bound in (4, 2**62):
        i, j = hard_negatives.best_columns(scores, 5, bound)
        found.append(sorted(zip(i.tolist(), j.tolist(), strict=True)))
    plain = [(i, j) for i in range(40) for j in sorted((j for j in range(23) if scores[i, j] != hard_negatives.NONE), key=lambda j: (-scores[i, j], j))[:5]]
    assert found[0] == found[1] == sorted(plain)
