"""Exact nearest rows: points fall into the cells of a kd tree, within a cell into leaves, and only what may hold one of the k nearest is compared.

Distances are sums of squared steps, column by column, rounded to DIGITS.
Subtraction, squares, sums and rounding keep order, so a box's distance that is
reckoned in the same way is never above that of a row in the box.
"""

from __future__ import annotations

import heapq

import numpy as np

DIGITS = 9
LEAF = 128  # rows that are left out together
GROUP = 64  # asking rows that share their candidates
MOST = 1 << 21  # distances at once


class Cells:
    """A kd tree over a sample's rows: boxes that hold about equal shares of it. Any finite row lies in exactly one."""

    def __init__(self, sample: np.ndarray, n: int, p: int):
        self.nodes, self.lo, self.hi = [], [np.full(p, -np.inf)], [np.full(p, np.inf)]
        self.root, heap = [0], [(-len(sample), 0, sample, (None, 0))]  # heap: size, cell, rows, where the cell's number stands
        while heap and len(self.lo) < n:
            _, cell, rows, (parent, side) = heapq.heappop(heap)
            cut = _cut(rows)
            if cut is None:
                continue
            j, value = cut
            new = len(self.lo)
            self.lo.append(self.lo[cell].copy())
            self.hi.append(self.hi[cell].copy())
            self.hi[cell][j] = self.lo[new][j] = value
            self.nodes.append([j, value, ~cell, ~new])
            at = len(self.nodes) - 1
            if parent is None:
                self.root[0] = at
            else:
                self.nodes[parent][2 + side] = at
            left = rows[:, j] <= value
            for s, c, part in ((0, cell, rows[left]), (1, new, rows[~left])):
                heapq.heappush(heap, (-len(part), c, part, (at, s)))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell; -1 for rows that aren't finite."""
        out = np.where(np.isfinite(x).all(axis=1), 0, -1).astype(np.int32)
        todo = [(self.root[0], np.flatnonzero(out == 0))] if self.nodes else []
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
                continue
            j, value, left, right = self.nodes[node]
            low = x[at, j] <= value
            todo += [(left, at[low]), (right, at[~low])]
        return out

    def others(self, cell: int, ask: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking row, cell), by row: the cells beside its own whose rows may be as near as the bound."""
        at, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in (np.flatnonzero(np.isfinite(bound)), np.flatnonzero(~np.isfinite(bound))):
            if len(part):
                q, b = ask[part], bound[part]
                for c in np.flatnonzero(gaps(self.lo, self.hi, q.min(axis=0), q.max(axis=0)) <= b.max()):
                    if c != cell:
                        reached = part[gaps(self.lo[c], self.hi[c], q, q) <= b]
                        at.append(reached)
                        found.append(np.full(len(reached), c))
        at, found = np.concatenate(at), np.concatenate(found)
        order = np.lexsort((found, at))
        return at[order], found[order]


def _cut(rows: np.ndarray) -> tuple[int, float] | None:
    """(column, value) of a cut near the middle of the column that varies most; rows up to the value lie left, and there are some right."""
    if len(rows) < 2:
        return None
    with np.errstate(all="ignore"):
        order = np.argsort(-np.nan_to_num(rows.std(axis=0)), kind="stable")
    for j in order:
        x = np.sort(rows[:, j])
        if x[0] < x[-1]:
            value = x[(len(x) - 1) // 2]
            return int(j), float(value if value < x[-1] else x[np.searchsorted(x, value) - 1])
    return None


def gaps(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray) -> np.ndarray:
    """The least distance between a row of one box and one of the other."""
    total = 0.0
    with np.errstate(all="ignore"):
        for j in range(lo.shape[-1]):
            step = np.maximum(np.maximum(lo[..., j] - qhi[..., j], qlo[..., j] - hi[..., j]), 0.0)
            total = total + step * step
        return np.round(total, DIGITS)


def _together(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows that lie together, at most so many."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        part = x[at]
        j, half = int(np.argmax(part.max(axis=0) - part.min(axis=0))), len(at) // 2
        order = np.argpartition(part[:, j], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def needed(x: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Places, by code, of the rows without which some k nearest would differ: of equal rows those with the least codes, k of them besides any one code's own."""
    if not len(x):
        return np.empty(0, np.int64)
    _, point = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((code, point))
    starts = np.concatenate(([True], np.diff(point[order]) != 0))
    runs = np.flatnonzero(np.concatenate((starts[1:] | (np.diff(code[order]) != 0), [True])))
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    kept = order[place < k + int(np.diff(np.concatenate(([-1], runs))).max())]
    return kept[np.lexsort((*x[kept].T[::-1], code[kept]))]


def k_nearest(x: np.ndarray, code: np.ndarray, ask: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking row, row, distance), by asking row, distance and place: the k nearest rows whose code isn't the asking row's own. x: by code."""
    leaves = _together(x, LEAF)
    lo, hi = (np.array([f(x[at], axis=0) for at in leaves]).reshape(len(leaves), x.shape[1]) for f in (np.min, np.max))
    sizes, out = np.array([len(at) for at in leaves]), []
    for group in _together(ask, GROUP) if leaves else ():
        q, mine = ask[group], own[group]
        gap = gaps(lo, hi, q.min(axis=0), q.max(axis=0))
        near = np.argsort(gap, kind="stable")
        near = near[: np.searchsorted(np.cumsum(sizes[near]), 2 * k) + 1]
        d = _distances(x, code, np.concatenate([leaves[i] for i in near]), q, mine)
        bound = np.partition(d, k - 1, axis=1)[:, k - 1].max() if d.shape[1] >= k else np.inf
        rows = np.sort(np.concatenate([leaves[i] for i in np.flatnonzero(gap <= bound)]))
        step = max(1, MOST // len(rows))
        for i in range(0, len(q), step):
            d = _distances(x, code, rows, q[i : i + step], mine[i : i + step])
            kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(rows) >= k else np.inf
            r, c = np.nonzero((d <= kth) & np.isfinite(d))
            far = d[r, c]
            order = np.lexsort((c, far, r))
            r, c, far = r[order], c[order], far[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((group[i + r[first]], rows[c[first]], far[first]))
    at, found, far = (np.concatenate([*(o[i] for o in out), np.empty(0, kind)]) for i, kind in enumerate((np.int64, np.int64, float)))
    order = np.argsort(at, kind="stable")
    return at[order], found[order], far[order]


def _distances(x: np.ndarray, code: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    d = np.zeros((len(q), len(rows)))
    with np.errstate(all="ignore"):
        for j in range(x.shape[1]):
            step = x[rows, j][None, :] - q[:, j][:, None]
            step *= step
            d += step
        d = np.round(d, DIGITS, out=d)
    d[(code[rows][None, :] == own[:, None]) | np.isnan(d)] = np.inf
    return d
