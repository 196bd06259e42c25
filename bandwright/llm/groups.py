"""Groups of rows in sorted partitions, many at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

# Rows handed on at a time, about; a group is never cut.
ROWS = 20_000


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = ROWS
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the bounds of each group.

    Groups must be of bounded size; integer keys without nulls.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        bounds = group_bounds(table, keys)
        cut = int(bounds[-2])
        if cut:
            yield table.slice(0, cut), bounds[:-1]
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        table = pa.Table.from_batches(held)
        yield table, group_bounds(table, keys)


def group_bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each group begins, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def pairs_within(bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within each group, about ``most`` at a time."""
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    after = end - np.arange(bounds[-1]) - 1
    total = np.cumsum(after)
    first = 0
    while first < len(after):
        done = total[first - 1] if first else 0
        last = max(int(np.searchsorted(total, done + most, "right")), first + 1)
        counts = after[first:last]
        left = np.repeat(np.arange(first, last), counts)
        start = np.cumsum(counts) - counts
        right = left + 1 + np.arange(len(left)) - np.repeat(start, counts)
        yield left, right
        first = last


def joined_up(least: np.ndarray, i: np.ndarray, j: np.ndarray, items: np.ndarray) -> None:
    """Let each row point to the row with the least item that it reaches by links."""
    while True:
        a, b = least[i], least[j]
        if (a == b).all():
            return
        small = np.where(items[a] <= items[b], a, b)
        large = np.where(items[a] <= items[b], b, a)
        # Of several hooks of one row, the one to the least item holds.
        order = np.argsort(-items[small], kind="stable")
        hooks = np.arange(len(least))
        hooks[large[order]] = small[order]
        while not (hooks[hooks] == hooks).all():
            hooks = hooks[hooks]
        least[:] = hooks[least]
