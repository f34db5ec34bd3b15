"""Longest common extensions of a sequence of numbers: a suffix tree and constant-time lowest common ancestors on its Euler tour."""

from __future__ import annotations

import numpy as np

#: Depths of the tour between two entries of the sparse table.
_BLOCK = 16


class _Minima:
    """Minimum of any stretch of an array: a sparse table over blocks, running minima inside each, and a scan where both ends share one."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = -(-n // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[:n] = values
        square = padded.reshape(blocks, _BLOCK)
        self.values = padded
        self.before = np.minimum.accumulate(square, axis=1).ravel()
        self.after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [square.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            step = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last], both included, for arrays of places with first <= last."""
        a, b = first // _BLOCK, last // _BLOCK
        out = np.minimum(self.after[first], self.before[last])
        inner = np.flatnonzero(b - a > 1)
        if len(inner):
            lo, count = a[inner] + 1, b[inner] - a[inner] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                some = level == k
                at = lo[some]
                end = at + count[some] - (1 << k)
                out[inner[some]] = np.minimum(out[inner[some]], np.minimum(self.table[k][at], self.table[k][end]))
        same = np.flatnonzero(a == b)
        if len(same):
            at, end = first[same].copy(), last[same]
            least = self.values[at]
            for _ in range(_BLOCK - 1):
                np.minimum(at + 1, end, out=at)
                np.minimum(least, self.values[at], out=least)
            out[same] = least
        return out


def _grown(symbols: list[int]) -> tuple[list[int], list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``symbols``, whose last one occurs nowhere else: per node the parent, the edge's first place and its end.

    Node 0 is the root; a leaf's edge has the length of the text as its end.  Children are found in one table by (node, first symbol).
    """
    n = len(symbols)
    width = max(symbols) + 1
    start, end, link, parent = [0], [0], [0], [0]
    child: dict[int, int] = {}
    node = edge = length = left = 0  # active point, and suffixes still to be entered
    for i in range(n):
        c = symbols[i]
        left += 1
        pending = 0  # the inner node made last, which waits for its suffix link
        while left:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i), end.append(n), link.append(0), parent.append(node)
                if pending:
                    link[pending] = node
                    pending = 0
            else:
                size = min(end[below], i + 1) - start[below]
                if length >= size:
                    node, edge, length = below, edge + size, length - size
                    continue
                at = start[below]
                if symbols[at + length] == c:
                    if pending:
                        link[pending] = node
                    length += 1
                    break
                # The edge is cut in two, and the new leaf hangs from the cut.
                inner = len(start)
                child[key] = inner
                start.append(at), end.append(at + length), link.append(0), parent.append(node)
                start[below], parent[below] = at + length, inner
                child[inner * width + symbols[at + length]] = below
                child[inner * width + c] = inner + 1
                start.append(i), end.append(n), link.append(0), parent.append(inner)
                if pending:
                    link[pending] = inner
                pending = inner
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return parent, start, end, child


class Extensions:
    """Longest common prefixes of the suffixes of a sequence, and the order of these suffixes under the alphabet and its reverse."""

    def __init__(self, symbols: np.ndarray):
        """``symbols``: whole numbers from 1 on; the end of the sequence is less than all of them in both orders."""
        text = symbols.tolist() + [0]
        parent_, start_, end_, child = _grown(text)
        nodes, n = len(start_), len(text)
        parent, start, end = np.array(parent_), np.array(start_), np.array(end_)
        del parent_, start_, end_, child
        codes = np.array(text)
        first = codes[start]
        first[0] = 0
        # Children of one parent stand together, in the order of their first symbols.
        order = np.lexsort((first[1:], parent[1:])) + 1
        counts = np.bincount(parent[1:], minlength=nodes)
        begin = np.concatenate(([0], np.cumsum(counts)))
        order_, begin_ = order.tolist(), begin.tolist()
        size = (end - start).tolist()
        depths: list[int] = []  # of the nodes along the tour
        where = [0] * n  # a suffix's place in the tour
        leaves: list[int] = []
        path, nexts, deep = [0], [begin_[0]], [0]
        while path:
            v, at, d = path[-1], nexts[-1], deep[-1]
            depths.append(d)
            if begin_[v] == begin_[v + 1]:
                where[n - d] = len(depths) - 1
                leaves.append(n - d)
            if at == begin_[v + 1]:
                path.pop(), nexts.pop(), deep.pop()
                continue
            nexts[-1] = at + 1
            below = order_[at]
            path.append(below), nexts.append(begin_[below]), deep.append(d + size[below])
        self.where = np.array(where)
        self.minima = _Minima(np.array(depths, np.int64))
        self.n = n - 1
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and at ``b`` (0 to n; n is empty) share from their beginning; a <> b."""
        x, y = self.where[a], self.where[b]
        return self.minima.between(np.minimum(x, y), np.maximum(x, y))
