"""Sets of raster cells as sorted numbers: erosion and components of many groups of cells at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Cells that are worked on at once, about.
BATCH = 1 << 18


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, of about BATCH rows (more only if a group is larger). Rows come group by group; ``first`` marks where one begins."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)) if rows + batch.num_rows > BATCH else ()
        if len(starts):
            if rows + starts[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held, rows, batch = [], 0, batch.slice(starts[-1])
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def numbered(first: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    """(a number for each cell, the width of a row) for cells sorted by group, y, x. Cells next to each other in a row differ by 1, in a column by the width; groups, and rows
    and columns that are not neighbours, are kept apart by an empty one. So numbers stay small wherever cells lie."""
    down = np.diff(y, prepend=y[:1])
    row = np.cumsum(np.where(first | (down > 1), 2, down))
    columns, at = np.unique(x, return_inverse=True)
    column = np.cumsum(np.where(np.diff(columns, prepend=columns[:1] - 2) == 1, 1, 2))
    width = int(column[-1]) + 2
    return row * width + column[at], width


def eroded(key: np.ndarray, width: int) -> np.ndarray:
    """Places in ``key`` (sorted, different) of the cells whose eight neighbours are there too."""
    middle = np.flatnonzero((key[:-2] + 1 == key[1:-1]) & (key[2:] - 1 == key[1:-1])) + 1
    flat = key[middle]
    return middle[np.isin(flat - width, flat, assume_unique=True) & np.isin(flat + width, flat, assume_unique=True)]


def parts(key: np.ndarray, width: int) -> np.ndarray:
    """For each of ``key`` (sorted, different) the place of the first cell of its 8-connected component. Runs of cells are joined to those that touch them in the row
    above, then roots take the least root that they touch until none is left."""
    start = np.flatnonzero(np.diff(key, prepend=key[:1] - 2) != 1)
    length = np.diff(np.append(start, len(key)))
    lo, hi = key[start], key[start + length - 1]
    above = np.searchsorted(hi, lo - width - 1)
    touched = np.maximum(np.searchsorted(lo, hi - width + 1, "right") - above, 0)
    a = np.repeat(np.arange(len(lo)), touched)
    b = np.arange(len(a)) - np.repeat(np.cumsum(touched) - touched - above, touched)
    root = np.arange(len(lo))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return np.repeat(start[root], length)
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
