"""BK-tree over reference strings under a true edit metric, searched for whole batches at once.

The metric is Levenshtein's. Queries go down the tree together: a frontier of (query, node) pairs is
measured by one vectorised dynamic program, and the triangle inequality keeps those children whose edge is
within the radius of the measured distance. The result is every entry within the radius.
"""

from __future__ import annotations

import numpy as np

from kvartal.functions.batch import encode


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each row of a and the same row of b."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int32)
    wa, wb = int(la.max()), int(lb.max())
    a, b = np.ascontiguousarray(a[:, :wa].T), np.ascontiguousarray(b[:, :wb].T)
    row = np.repeat(np.arange(wb + 1, dtype=np.int16)[:, None], n, 1)
    out = np.where(la == 0, lb, 0).astype(np.int16)
    at = np.arange(n)
    for i in range(wa):
        before = row
        row = np.empty_like(before)
        row[0] = i + 1
        change = before[:-1] + (a[i] != b)
        np.minimum(change, before[1:] + 1, out=change)
        for j in range(wb):
            np.minimum(change[j], row[j] + 1, out=row[j + 1])
        done = la == i + 1
        if done.any():
            out[done] = row[lb[done], at[done]]
    return out


class BKTree:
    """Entries are distinct, non-empty strings."""

    def __init__(self, entries: list[str]):
        self.entries = sorted(set(entries) - {""})
        self.width = max(map(len, self.entries), default=1)
        self.codes, self.lengths = encode(self.entries, self.width)
        n = len(self.entries)
        #: Of each node: its children and the distances on their edges.
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        # All nodes of a level are placed together: each still unplaced entry walks one step a round.
        waiting, at = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(waiting):
            d = distances(self.codes[waiting], self.lengths[waiting], self.codes[at], self.lengths[at])
            still, where = [], []
            for e, node, edge in zip(waiting.tolist(), at.tolist(), d.tolist()):
                child = self.children[node].setdefault(edge, e)
                if child != e:
                    still.append(e)
                    where.append(child)
            waiting, at = np.array(still, np.int64), np.array(where, np.int64)
        start, edges, kids = [0], [], []
        for c in self.children:
            for edge in sorted(c):
                edges.append(edge)
                kids.append(c[edge])
            start.append(len(kids))
        self.start, self.edges, self.kids = np.array(start), np.array(edges, np.int32), np.array(kids, np.int64)

    def search(self, queries: list[str], radius: int) -> list[list[tuple[int, int]]]:
        """For each query all (entry number, distance) with distance <= radius."""
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not self.entries or not queries:
            return found
        width = max(self.width, max(map(len, queries)))
        codes, lengths = encode(queries, width)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        q = q[lengths > 0]
        node = node[: len(q)]
        while len(q):
            d = np.concatenate([distances(codes[q[i : i + 65536]], lengths[q[i : i + 65536]], self.codes[node[i : i + 65536]], self.lengths[node[i : i + 65536]]) for i in range(0, len(q), 65536)])
            hit = np.flatnonzero(d <= radius)
            for i, e, x in zip(q[hit].tolist(), node[hit].tolist(), d[hit].tolist()):
                found[i].append((e, x))
            first, count = self.start[node], self.start[node + 1] - self.start[node]
            reps = np.repeat(np.arange(len(q)), count)
            edge_at = np.repeat(first, count) + np.arange(len(reps)) - np.repeat(np.cumsum(count) - count, count)
            keep = np.abs(self.edges[edge_at] - d[reps]) <= radius
            q, node = q[reps[keep]], self.kids[edge_at[keep]]
        return found


def typing_errors(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions, substitutions and swaps of neighbours between each two strings, each letter
    edited once."""
    if not a:
        return np.zeros(0, np.int32)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    wa, wb = int(la.max()), int(lb.max())
    x, y = np.ascontiguousarray(encode(a, max(wa, 1))[0].T), np.ascontiguousarray(encode(b, max(wb, 1))[0].T)
    at = np.arange(len(a))
    row = np.repeat(np.arange(wb + 1, dtype=np.int16)[:, None], len(a), 1)
    before = row
    out = np.where(la == 0, lb, 0).astype(np.int32)
    for i in range(wa):
        two, before = before, row
        row = np.empty_like(before)
        row[0] = i + 1
        change = before[:-1] + (x[i] != y[:wb])
        np.minimum(change, before[1:] + 1, out=change)
        if i:
            swapped = (x[i] == y[: wb - 1]) & (x[i - 1] == y[1:wb])
            np.minimum(change[1:], np.where(swapped, two[: wb - 1] + 1, np.int16(30000)), out=change[1:])
        for j in range(wb):
            np.minimum(change[j], row[j] + 1, out=row[j + 1])
        done = la == i + 1
        if done.any():
            out[done] = row[lb[done], at[done]]
    return out
