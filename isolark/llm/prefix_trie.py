"""The prefix trie of rebuilt conversations, from adaptive radix trees of shares of them.

A turn's id is the 128-bit hash of its role and text, so that turns are compared
by 16 big-endian bytes. Conversations are dealt by ranges of ids; a task streams
them in order, rebuilds each one and inserts its ids in a radix tree of bounded
size (a unit). The tree's turn-aligned nodes are written with the unit's own
counts, keyed by a chained hash of the ids from the root.

Counts of all units meet by that key, after each unit has counted its own, so a
first turn that a third of all conversations share is one row per unit. They go
back to the units, where each node of the whole trie is owned by the unit of its
smallest member. Sums over subtrees are differences of running sums in a unit's
order; a unit sums what it owns, and the sums of all units add up, because an
owner holds all ancestors of what it owns. No node is paired with its ancestors,
and depth costs no rounds.

Members that end at a node are hashed in a stream: units cover disjoint ranges
of ids, so their parts, each a piece of text, only have to be put in order.

Defined results: rows without conv_id take no part; a null role or text is
empty; turns of equal number, null ones too, come in the order of their ids, and
repeated rows are turns of their own; other columns, whatever their names, are
ignored. An empty table has no node, not even a root. A conversation that no row
stands for isn't rebuilt, one that ends up without turns is a member of the root
alone. The ids of one conversation, 24 bytes a turn, are held by one task; texts,
however long, are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.llm.common import Scratch, map_batches
from isolark.llm.radix_tree import Node, aligned, insert

WIDTH = 16
#: Turns of a unit, after which it is closed, and rows that are given out at once.
UNIT, ROWS = 150_000, 20_000
#: Conversations that share a beginning, and turns that are taken over at most plus one.
FAMILY, TAKEN = 5, 9

SHARE = "unit long, place long, size long, parent long, node binary, depth long, bytes long, n long, least long, inner boolean, ends string"
SHARE_TYPES = [pa.int64()] * 4 + [pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.string()]
SHARE_NAMES = [c.split()[0] for c in SHARE.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base (whose beginning it takes), taken (how many turns), turn, id and bytes of every row with a conv_id."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id IS NOT NULL")
    apart = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % TAKEN).alias("taken"),
        "turn", F.unhex(F.md5(apart)).alias("id"), F.octet_length("text").cast("long").alias("bytes"),
    )


class Unit:
    """Rebuilt conversations of one unit in a radix tree."""

    def __init__(self, number: int):
        self.number, self.root, self.turns = number, Node(b""), 0
        self.bytes: dict[bytes, int] = {}

    def add(self, conv_id: int, ids: list[bytes]) -> None:
        insert(self.root, b"".join(ids), conv_id)
        self.turns += len(ids) + 1

    def rows(self):
        """The nodes at whole turns in columns as SHARE, parents first."""
        depth, own, node, inner, ends, parent = [], [], [], [], [], []
        path: list[int] = []  # place of the last node of each depth
        for d, turn, members, below in aligned(self.root, WIDTH):
            del path[d:]
            parent.append(path[-1] if path else -1)
            node.append(hashlib.blake2b(node[path[-1]] + turn, digest_size=WIDTH).digest() if path else bytes(WIDTH))
            path.append(len(depth))
            depth.append(d)
            own.append(self.bytes.get(turn, 0))
            inner.append(below)
            ends.append(sorted(members))
        n = len(depth)
        size, members = np.ones(n, np.int64), np.array([len(e) for e in ends], np.int64)
        least = [e[0] if e else None for e in ends]
        size, members = size.tolist(), members.tolist()
        for i in range(n - 1, 0, -1):  # children stand behind their parents
            p = parent[i]
            size[p] += size[i]
            members[p] += members[i]
            if least[p] is None or least[i] < least[p]:
                least[p] = least[i]
        text = [",".join(map(str, e)) if e else None for e in ends]
        for at in range(0, n, ROWS):
            part = slice(at, min(n, at + ROWS))
            count = part.stop - at
            columns = [[self.number] * count, range(at, part.stop), size[part], parent[part], node[part], depth[part], own[part], members[part], least[part], inner[part], text[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SHARE_TYPES, strict=True)], SHARE_NAMES)


def _share(limit: int):
    """Conversations come one behind the other, the base of each family first."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        unit, family, base = Unit(first), None, []
        held: list[bytes] = []
        current, taken = None, 0

        def close() -> None:
            nonlocal base
            if current is None:
                return
            if current == family:
                base = held[: TAKEN - 1]
            unit.add(current, base[:taken] + held[taken:])

        for batch in batches:
            for conv_id, own_base, own_taken, turn_id, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "base", "taken", "id", "bytes")), strict=True):
                if conv_id != current:
                    close()
                    if own_base != family:
                        family, base = own_base, []
                        if unit.turns >= limit:
                            yield from unit.rows()
                            unit = Unit(unit.number + 1)
                    current, taken, held = conv_id, own_taken, []
                held.append(turn_id)
                unit.bytes[turn_id] = size
        close()
        if unit.turns:
            yield from unit.rows()

    return run


def shares(conversations: DataFrame, limit: int = UNIT) -> DataFrame:
    """The turn-aligned nodes of all units; units cover disjoint ranges of conversations in the order of their numbers."""
    rows = turns(conversations)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, "base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "id")
    return map_batches(dealt, _share(limit), SHARE)


SUMS = "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _sums(batches):
    """What each unit owns below its nodes; rows come by unit and place."""

    def out(rows: pa.Table):
        number = lambda c: rows.column(c).to_numpy()
        conv, n, place, size, parent = (number(c) for c in ("conv_id", "n_convs", "place", "size", "parent"))
        owned = number("least") == conv
        leaf = owned & ~rows.column("branches").to_numpy(zero_copy_only=False)
        children = np.zeros(len(conv), np.int64)
        np.add.at(children, parent[owned & (parent >= 0)], 1)
        below = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.stack([place, place + size])], axis=0)[0]
        above = pa.array(np.where(parent >= 0, conv[parent], 0), mask=parent < 0)
        columns = [rows.column("node"), rows.column("depth"), pa.array(conv), above, pa.array(n), pa.array(children), pa.array(below(leaf.astype(np.int64))), pa.array(below(np.where(owned, (n - 1) * number("bytes"), 0)))]
        yield from pa.Table.from_arrays(columns, [c.split()[0] for c in SUMS.split(", ")]).combine_chunks().to_batches(ROWS)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        units = batch.column("unit").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(units)) + 1, [len(units)]]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if held and held[-1].column("unit")[0].as_py() != units[a]:
                    yield from out(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield from out(pa.Table.from_batches(held))


def _hashed(batches):
    """SHA-256 of the parts of each node, joined by commas; they come by node and unit."""
    current, digest = None, None
    for batch in batches:
        nodes, found = [], []
        for node, part in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != current:
                if current is not None:
                    nodes.append(current)
                    found.append(digest.hexdigest())
                current, digest = node, hashlib.sha256(part.encode())
            else:
                digest.update(b"," + part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])


def trie(conversations: DataFrame, limit: int = UNIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    table = Scratch().keep(shares(conversations, limit))
    whole = table.groupBy("node").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.bool_or("inner").alias("branches"))
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = table.drop("ends", "n", "inner").join(whole, "node").repartition(tasks, "unit").sortWithinPartitions("unit", "place")
    owned = map_batches(back, _sums, SUMS)
    same = [F.first(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    nodes = owned.groupBy("node").agg(*same, *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    parts = table.where("ends IS NOT NULL").select("node", "unit", "ends").repartition(tasks, "node").sortWithinPartitions("node", "unit")
    ends = map_batches(parts, _hashed, "node binary, ends_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
