"""String kernels over many pairs at once: one numpy step a row of the dynamic programme, for all pairs of a block.

Pairs are sorted by size and cut into blocks of bounded memory.  In every kernel ``a`` and ``b`` are code points, a row
a pair, filled up with -1 and -2 (which equal nothing), and ``la`` and ``lb`` the lengths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Cells of a block: pairs times length, or times both lengths for kernels that keep the whole table.
CELLS = 1 << 21


def codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(n.max(initial=0))), fill, np.int32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    return out, n


def over_blocks(kernel: Callable, x: list[str], y: list[str], whole_table: bool = False) -> list:
    """``kernel(a, la, b, lb)`` of all pairs."""
    out: list = [None] * len(x)
    size = np.array([(len(p) + 2) * (len(q) + 2) if whole_table else max(len(p), len(q)) + 2 for p, q in zip(x, y)], np.int64)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        # the block's largest pair is its last: as many as fit
        j = i + 1
        while j < len(order) and (j - i + 1) * size[order[j]] * (4 if whole_table else 1) <= CELLS:
            j += 1
        at = order[i:j].tolist()
        a, la = codes([x[k] for k in at], -1)
        b, lb = codes([y[k] for k in at], -2)
        for k, v in zip(at, kernel(a, la, b, lb)):
            out[k] = v
        i = j
    return out


def _insertions(base: np.ndarray, first: np.ndarray | int) -> np.ndarray:
    """A row of an edit distance: each place the least of itself and the place before plus 1."""
    row = np.concatenate([np.broadcast_to(np.asarray(first, base.dtype), (len(base), 1)), base], axis=1)
    step = np.arange(row.shape[1], dtype=base.dtype)
    return np.minimum.accumulate(row - step, axis=1) + step


def osa(a, la, b, lb) -> list[int]:
    """Edits and swaps of neighbours, no place edited twice."""
    n, width = len(a), b.shape[1]
    row = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (n, width + 1))
    before, out = row, lb.copy()
    for i in range(1, a.shape[1] + 1):
        same = a[:, i - 1, None] == b
        base = np.minimum(row[:, 1:] + 1, row[:, :-1] + ~same)
        if i > 1 and width > 1:
            swap = (a[:, i - 1, None] == b[:, :-1]) & (a[:, i - 2, None] == b[:, 1:])
            base[:, 1:] = np.where(swap, np.minimum(base[:, 1:], before[:, :-2] + 1), base[:, 1:])
        before, row = row, _insertions(base.astype(np.int32), i)
        done = np.flatnonzero(la == i)
        out[done] = row[done, lb[done]]
    return out.tolist()


def damerau(a, la, b, lb) -> list[int]:
    """Edits and swaps of neighbours, where what was swapped may be edited again."""
    n, height, width = len(a), a.shape[1], b.shape[1]
    top = height + width
    table = np.full((n, height + 2, width + 2), top, np.int32)
    table[:, 1, 1:] = np.arange(width + 1)
    out, last = lb.copy(), np.zeros((n, width), np.int64)
    pairs, j = np.arange(n)[:, None], np.arange(1, width + 1)
    for i in range(1, height + 1):
        same = a[:, i - 1, None] == b
        # the last place before this one whose character is the row's
        upto = np.maximum.accumulate(np.where(same, j, 0), axis=1) if width else np.zeros((n, 0), np.int64)
        at = np.concatenate([np.zeros((n, min(width, 1)), np.int64), upto[:, :-1]], axis=1)
        swap = table[pairs, last, at] + (i - last - 1) + 1 + (j - at - 1)
        base = np.minimum(np.minimum(table[:, i, 1:-1] + ~same, table[:, i, 2:] + 1), swap)
        table[:, i + 1, 1:] = _insertions(base.astype(np.int32), i)
        last = np.where(same, i, last)
        done = np.flatnonzero(la == i)
        out[done] = table[done, i + 1, lb[done] + 1]
    return out.tolist()


def lcs_length(a, la, b, lb) -> list[int]:
    """Length of the longest common subsequence (what is filled up matches nothing)."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        row[:, 1:] = np.maximum.accumulate(np.where(a[:, i, None] == b, row[:, :-1] + 1, row[:, 1:]), axis=1)
    return row[:, -1].tolist()


def lcs_subseq(a, la, b, lb) -> list[str]:
    """The longest common subsequence, found from the ends; on a tie one goes back in the first string."""
    n = len(a)
    table = np.zeros((n, a.shape[1] + 1, b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        table[:, i + 1, 1:] = np.maximum.accumulate(np.where(a[:, i, None] == b, table[:, i, :-1] + 1, table[:, i, 1:]), axis=1)
    i, j, taken = la.copy(), lb.copy(), np.zeros(a.shape, bool)
    open_ = np.flatnonzero((i > 0) & (j > 0))
    while len(open_):
        p, q = i[open_], j[open_]
        same = a[open_, p - 1] == b[open_, q - 1]
        up = ~same & (table[open_, p - 1, q] >= table[open_, p, q - 1])
        taken[open_[same], p[same] - 1] = True
        i[open_] -= same | up
        j[open_] -= ~up
        open_ = open_[(i[open_] > 0) & (j[open_] > 0)]
    return ["".join(map(chr, row[hit].tolist())) for row, hit in zip(a, taken)]


def lcs_substr(a, la, b, lb) -> list[str]:
    """The longest common substring that ends first in the longer string (the first one, if they are equally long)."""
    swap = la < lb
    width = max(a.shape[1], b.shape[1])
    wide = lambda x, fill: np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=fill)
    a, b = wide(a, -1), wide(b, -2)
    long, short = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    best, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    row = np.zeros((len(a), width + 1), np.int32)
    for i in range(width):
        row[:, 1:] = np.where(long[:, i, None] == short, row[:, :-1] + 1, 0)
        most = row.max(axis=1)
        better = most > best
        best[better], end[better] = most[better], i + 1
    return ["".join(map(chr, x[e - m : e].tolist())) for x, m, e in zip(long, best, end)]


def jaro(a, la, b, lb) -> list[float]:
    n, width = len(a), b.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    j = np.arange(width)
    hit_a, hit_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i in range(a.shape[1] if width else 0):
        free = (a[:, i, None] == b) & ~hit_b & (np.abs(j - i) <= reach[:, None])
        first = free.argmax(axis=1)
        found = np.flatnonzero(free[np.arange(n), first])
        hit_a[found, i] = hit_b[found, first[found]] = True
    m = hit_a.sum(axis=1)
    least = min(a.shape[1], width)
    in_order = lambda x, hit: np.take_along_axis(x, np.argsort(~hit, axis=1, kind="stable"), axis=1)[:, :least]
    swapped = ((in_order(a, hit_a) != in_order(b, hit_b)) & (np.arange(least) < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (m / la + m / lb + (m - swapped) / m) / 3
    s = np.where(m == 0, 0.0, s)
    return np.where((la == 0) & (lb == 0), 1.0, s).tolist()


def jaro_winkler(a, la, b, lb, weight: float = 0.1) -> list[float]:
    s = np.array(jaro(a, la, b, lb))
    k = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[:, :k] == b[:, :k], axis=1).sum(axis=1) if k else 0
    return np.where(s > 0.7, np.minimum(1.0, s + prefix * weight * (1 - s)), s).tolist()
