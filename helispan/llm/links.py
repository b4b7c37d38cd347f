"""Links among the things of one task: how many rows each is linked with, and which are connected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCHEMA = "src long, dst long, links long"


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least connected number for each of ``n``, over the links between ``a`` and ``b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


class Links:
    """Collects tables of links block by block; holds a few numbers for each thing, and no pairs."""

    def __init__(self, copies: np.ndarray) -> None:
        self.copies = copies
        self.count = np.zeros(len(copies), np.int64)
        self.root = np.arange(len(copies))

    def add(self, rows: np.ndarray, columns: np.ndarray, found: np.ndarray, both: bool = True) -> None:
        """Things ``rows`` are linked with ``columns`` where ``found``; with ``both``, counted on both sides."""
        self.count[rows] += found @ self.copies[columns]
        if both:
            self.count[columns] += self.copies[rows] @ found
        p, q = np.nonzero(found)
        a, b = self.root[rows[p]], self.root[columns[q]]
        differ = a != b
        if differ.any():
            pairs = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0)
            self.root = roots(len(self.root), pairs[:, 0], pairs[:, 1])[self.root]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        """``src, dst, links`` of each linked thing and one that it is connected with."""
        some = np.flatnonzero(self.count)
        columns = ids[some], ids[self.root[some]], self.count[some]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["src", "dst", "links"])
