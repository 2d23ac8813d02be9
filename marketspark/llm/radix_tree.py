"""Adaptive radix tree over byte strings: nodes widen as they fill, single-child paths are compressed."""

from __future__ import annotations

from bisect import bisect_left


class Small:
    """Up to ``room`` children: their bytes in order beside them."""

    __slots__ = ("room", "bytes", "children")

    def __init__(self, room: int, bytes_: bytearray | None = None, children: list | None = None):
        self.room, self.bytes, self.children = room, bytes_ if bytes_ is not None else bytearray(), children if children is not None else []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, child) -> "Small | Indexed":
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
            return self
        if len(self.bytes) == self.room:
            wider = Small(16, self.bytes, self.children) if self.room == 4 else Indexed(self)
            return wider.put(byte, child)
        self.bytes.insert(at, byte)
        self.children.insert(at, child)
        return self

    def ordered(self) -> list:
        return self.children


class Indexed:
    """Up to 48 children: a place for each byte leads into a short list."""

    __slots__ = ("place", "children")

    def __init__(self, full: Small):
        self.place, self.children = bytearray(256), list(full.children)
        for at, byte in enumerate(full.bytes):
            self.place[byte] = at + 1

    def get(self, byte: int):
        at = self.place[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child) -> "Indexed | Direct":
        if at := self.place[byte]:
            self.children[at - 1] = child
            return self
        if len(self.children) == 48:
            return Direct(self).put(byte, child)
        self.children.append(child)
        self.place[byte] = len(self.children)
        return self

    def ordered(self) -> list:
        return [self.children[at - 1] for at in self.place if at]


class Direct:
    """A child per byte."""

    __slots__ = ("slots",)

    def __init__(self, full: Indexed):
        self.slots = [full.get(byte) for byte in range(256)]

    def get(self, byte: int):
        return self.slots[byte]

    def put(self, byte: int, child) -> "Direct":
        self.slots[byte] = child
        return self

    def ordered(self) -> list:
        return [child for child in self.slots if child is not None]


class Node:
    """``path`` is the compressed run of bytes that leads here; ``value`` is set where a key ends."""

    __slots__ = ("path", "value", "layout")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.layout = path, value, None

    def add(self, child: "Node") -> None:
        self.layout = (self.layout or Small(4)).put(child.path[0], child)

    def children(self) -> list["Node"]:
        return self.layout.ordered() if self.layout else []


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class RadixTree:
    """Keys may be empty and may be prefixes of others; a key's value must not be None."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.layout.get(key[at]) if node.layout else None
            if child is None:
                node.add(Node(key[at:], value))
                return
            rest = key[at : at + len(child.path)]
            same = shared(child.path, rest)
            if same < len(child.path):  # split the path
                upper = Node(child.path[:same])
                child.path = child.path[same:]
                upper.add(child)
                node.add(upper)
                child = upper
            node, at = child, at + same
        node.value = value
