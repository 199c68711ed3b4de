"""An adaptive radix tree over byte strings made of fixed-width ids.

Keys are big-endian ids one behind the other. Inner nodes branch on one byte and
have one of four layouts that grow with the number of children (sorted bytes
with up to 4 or 16 children, an index of bytes with up to 48, a full table of
256); bytes that all keys below a node share are kept in the node (path
compression). A key may end inside another, so nodes hold the members that end
there. Of the byte depths, only those at a whole number of ids are nodes of the
trie of ids: :func:`aligned` walks the tree and gives just these.
"""

from __future__ import annotations

from collections.abc import Iterator


class Sorted:
    """Up to ``room`` children beside their sorted bytes."""

    __slots__ = ("keys", "room", "nodes")

    def __init__(self, room: int, keys: bytes = b"", nodes: list | None = None):
        self.room, self.keys, self.nodes = room, bytearray(keys), nodes or []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node) -> Sorted | Indexed:
        at = self.keys.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            wider = Sorted(16, bytes(self.keys), self.nodes) if self.room == 4 else Indexed(self.items())
            return wider.put(byte, node)
        at = sum(1 for k in self.keys if k < byte)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.nodes, strict=True)


class Indexed:
    """Up to 48 children, found through a table from bytes to places."""

    __slots__ = ("place", "nodes")
    ROOM = 48

    def __init__(self, items):
        self.place, self.nodes = bytearray(256), []
        for byte, node in items:
            self.nodes.append(node)
            self.place[byte] = len(self.nodes)

    def get(self, byte: int):
        at = self.place[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> Indexed | Full:
        at = self.place[byte]
        if at:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == self.ROOM:
            return Full(self.items()).put(byte, node)
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[at - 1]) for byte, at in enumerate(self.place) if at)


class Full:
    """A child for any byte."""

    __slots__ = ("nodes",)

    def __init__(self, items):
        self.nodes = [None] * 256
        for byte, node in items:
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> Full:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """``path`` leads from the parent's branching byte, that byte included, to this node."""

    __slots__ = ("path", "children", "ends")

    def __init__(self, path: bytes, children=None, ends: list | None = None):
        self.path, self.children, self.ends = path, children if children is not None else Sorted(4), ends if ends is not None else []


def common_length(path: bytes, key: bytes, at: int) -> int:
    """How many bytes ``path`` shares with ``key`` from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    size = min(len(path), len(key) - at)
    differ = int.from_bytes(path[:size], "big") ^ int.from_bytes(key[at : at + size], "big")
    return size - (differ.bit_length() + 7) // 8


def insert(root: Node, key: bytes, member) -> None:
    node, at = root, 0
    while at < len(key):
        child = node.children.get(key[at])
        if child is None:
            node.children = node.children.put(key[at], Node(key[at:], ends=[member]))
            return
        same = common_length(child.path, key, at)
        if same < len(child.path):
            middle = Node(child.path[:same])
            child.path = child.path[same:]
            middle.children = middle.children.put(child.path[0], child)
            node.children = node.children.put(key[at], middle)
            child = middle
        node, at = child, at + same
    node.ends.append(member)


def aligned(root: Node, width: int) -> Iterator[tuple[int, bytes, list, bool]]:
    """(depth, id, members that end there, has children) of the nodes at whole ids, parents first, subtrees together."""
    yield 0, b"", root.ends, bool(len(list(root.children.items())))
    stack = [(node, 0, b"") for _, node in root.children.items()][::-1]
    while stack:
        node, depth, begun = stack.pop()
        path = begun + node.path
        whole = len(path) // width
        below = list(node.children.items())
        for i in range(whole):
            last = i + 1 == whole and len(path) == whole * width
            yield depth + i + 1, path[i * width : (i + 1) * width], node.ends if last else [], bool(below) if last else True
        rest = path[whole * width :]
        stack += [(child, depth + whole, rest) for _, child in reversed(below)]
