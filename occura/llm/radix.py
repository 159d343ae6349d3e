"""An adaptive radix tree over byte strings: node layouts grow with their number of children, and single paths are compressed."""

from __future__ import annotations

from bisect import bisect_left


class Few:
    """Up to ``room`` children: sorted bytes beside the children."""

    __slots__ = ("keys", "kids", "room")

    def __init__(self, room: int):
        self.keys, self.kids, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, child) -> bool:
        """Set a child; False if there is no room for another."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = child
        elif len(self.keys) == self.room:
            return False
        else:
            self.keys.insert(at, byte)
            self.kids.insert(at, child)
        return True

    def items(self):
        return zip(self.keys, self.kids, strict=True)


class Indexed:
    """Up to 48 children in order of arrival, found by a table of 256 places."""

    __slots__ = ("kids", "place")
    room = 48

    def __init__(self):
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int):
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, child) -> bool:
        if self.place[byte]:
            self.kids[self.place[byte] - 1] = child
        elif len(self.kids) == self.room:
            return False
        else:
            self.kids.append(child)
            self.place[byte] = len(self.kids)
        return True

    def items(self):
        return ((byte, self.kids[at - 1]) for byte, at in enumerate(self.place) if at)


class Full:
    """A place for every byte."""

    __slots__ = ("kids",)
    room = 256

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, child) -> bool:
        self.kids[byte] = child
        return True

    def items(self):
        return ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


#: The layout after each number of children that a layout has room for.
LARGER = {4: lambda: Few(16), 16: Indexed, 48: Full}


class Node:
    """A compressed path, the values of the key that ends at its end, and the children there."""

    __slots__ = ("children", "prefix", "values")

    def __init__(self, prefix: bytes, values: list):
        self.prefix, self.values, self.children = prefix, values, None

    def child(self, byte: int) -> Node | None:
        return self.children.get(byte) if self.children else None

    def put(self, byte: int, child: Node) -> None:
        if self.children is None:
            self.children = Few(4)
        while not self.children.put(byte, child):
            larger = LARGER[self.children.room]()
            for b, kid in self.children.items():
                larger.put(b, kid)
            self.children = larger

    def items(self):
        return self.children.items() if self.children else ()


def common(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, different up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class Tree:
    """Byte strings with lists of values."""

    def __init__(self):
        self.root = Node(b"", [])

    def insert(self, key: bytes, value) -> None:
        node, above, byte, at = self.root, None, 0, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                same = common(prefix, key[at : at + len(prefix)])
                upper = Node(prefix[:same], [])
                upper.put(prefix[same], node)
                node.prefix = prefix[same + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node, prefix = upper, upper.prefix
            at += len(prefix)
            if at == len(key):
                node.values.append(value)
                return
            above, byte, node = node, key[at], node.child(key[at])
            at += 1
            if node is None:
                above.put(byte, Node(key[at:], [value]))
                return

    def walk(self):
        """(node, depth in bytes where its path ends, True) on the way down and (node, depth, False) on the way up, children by byte."""
        open_ = [(self.root, len(self.root.prefix), iter(self.root.items()))]
        yield self.root, len(self.root.prefix), True
        while open_:
            node, depth, rest = open_[-1]
            found = next(rest, None)
            if found is None:
                open_.pop()
                yield node, depth, False
                continue
            child = found[1]
            below = depth + 1 + len(child.prefix)
            open_.append((child, below, iter(child.items())))
            yield child, below, True
