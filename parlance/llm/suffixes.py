"""Deep-shallow sorting of many short suffixes: their order and common prefixes.

Suffixes come in groups. Multikey quicksort works to a shallow depth, eight bytes as one key for all groups at once;
suffixes that are still equal there (or end there) go to a blind trie, which orders those that are left by the
places where they branch, looking at each suffix's other bytes only once, to prove its branch.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at before the blind tries take over.
SHALLOW = 48


def _key(matrix: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes from ``depth`` on as one number (zeros past the end), and how many there are."""
    part = np.zeros((len(matrix), 8), np.uint8)
    width = min(8, matrix.shape[1] - depth)
    if width > 0:
        part[:, :width] = matrix[:, depth : depth + width]
    return part.view(">u8")[:, 0].astype(np.uint64), np.clip(length - depth, 0, 8)


def _common(a: bytes, b: bytes, from_: int) -> int:
    """Length of the common prefix, known to be ``from_`` at least."""
    n = min(len(a), len(b))
    if a[from_:n] == b[from_:n]:
        return n
    low, high = from_, n  # equal to low, different before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Inner nodes hold the depth at which their children differ; only leaves know their suffix."""

    def __init__(self, suffixes: list[bytes], depth: int):
        self.suffixes = suffixes
        self.root: object = 0  # a leaf is the number of its suffix; a node is [depth, {byte: child}, leaves that are equal or end here]
        self.floor = depth
        self.same: dict[int, list[int]] = {}
        for i in range(1, len(suffixes)):
            self.insert(i)

    def _byte(self, i: int, depth: int) -> int:
        s = self.suffixes[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        node, path = self.root, []
        while isinstance(node, list):  # blindly: bytes between branches are not compared
            path.append(node)
            child = node[1].get(self._byte(i, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other, mine = self.suffixes[node], self.suffixes[i]
        lcp = _common(other, mine, self.floor)
        if lcp == len(other) == len(mine):
            self.same.setdefault(node, []).append(i)
            return
        above = None
        for step in path:
            if step[0] >= lcp:
                break
            above = step
        below = self.root if above is None else above[1][self._byte(i, above[0])]
        if isinstance(below, list) and below[0] == lcp:
            below[1][self._byte(i, lcp)] = i
            return
        branch = [lcp, {self._byte(node, lcp): below, self._byte(i, lcp): i}]
        if above is None:
            self.root = branch
        else:
            above[1][self._byte(i, above[0])] = branch

    def order(self) -> tuple[list[int], list[int]]:
        """Suffixes in order, and the common prefix of each with the one before it (the first: -1)."""
        out: list[int] = []
        lcps: list[int] = []
        stack: list[tuple[object, int]] = [(self.root, -1)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, list):
                children = sorted(node[1].items(), reverse=True)
                stack += [(child, node[0]) for _, child in children[:-1]]
                stack.append((children[-1][1], lcp))
            else:
                out.append(node)
                lcps.append(lcp)
                for twin in self.same.get(node, ()):
                    out.append(twin)
                    lcps.append(len(self.suffixes[node]))
        return out, lcps


def deep_shallow(group: np.ndarray, suffixes: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes inside their groups, and common prefixes with the one before (-1 at the start of a group)."""
    n = len(suffixes)
    length = np.fromiter(map(len, suffixes), np.int64, n)
    width = int(min(shallow, length.max(initial=0)))
    matrix = np.zeros((n, max(width, 1)), np.uint8)
    if width:
        flat = np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in suffixes]), np.uint8)
        matrix = flat.reshape(n, width)
    order = np.argsort(group, kind="stable")
    lcp = np.full(n, -1, np.int64)
    segment = group[order]  # equal numbers are still to be told apart
    _, segment = np.unique(segment, return_inverse=True)
    alive = np.ones(n, bool)
    new = np.ones(n, bool)
    new[1:] = segment[1:] != segment[:-1]
    alive = ~(new & np.append(new[1:], True))
    for depth in range(0, width, 8):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        key, have = _key(matrix[order[at]], length[order[at]], depth)
        seg = segment[at]
        inner = np.lexsort((have, key, seg))
        order[at], key, have, seg = order[at][inner], key[inner], have[inner], seg[inner]
        same_seg = seg[1:] == seg[:-1]
        differ = (key[1:] != key[:-1]) | (have[1:] != have[:-1])
        cut = np.flatnonzero(same_seg & differ)
        if len(cut):
            x = key[cut] ^ key[cut + 1]
            lead = np.full(len(cut), 8, np.int64)
            for b in range(7, -1, -1):
                lead[(x >> np.uint64(8 * (7 - b))) & np.uint64(255) != 0] = b
            lcp[at[cut + 1]] = depth + np.minimum(lead, np.minimum(have[cut], have[cut + 1]))
        new = np.ones(len(at), bool)
        new[1:] = ~(same_seg & ~differ)
        segment[at] = np.maximum.accumulate(np.where(new, at, 0))
        alone = new & np.append(new[1:], True)
        ended = have < 8  # equal to the end: twins
        twins = np.flatnonzero(~new & ended)
        lcp[at[twins]] = length[order[at[twins]]]
        alive[at] = ~alone & ~ended
    at = np.flatnonzero(alive)
    if len(at):
        seg = segment[at]
        edges = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        for lo, hi in zip(edges, np.append(edges[1:], len(at)), strict=True):
            where = at[lo:hi]
            members = order[where]
            sorted_, lcps = BlindTrie([suffixes[i] for i in members], width).order()
            order[where] = members[sorted_]
            lcp[where[1:]] = lcps[1:]
    return order, lcp
