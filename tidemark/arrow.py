"""Whole groups of rows as Arrow tables, many small groups at a time, inside mapInArrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, keys: list[str], most_rows: int = 4096, most_bytes: int = 4 << 20):
    """Tables of whole groups from record batches sorted by keys; a table holds several small groups, or one large one."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), most_rows):
            part = batch.slice(at, most_rows)
            if not part.num_rows:
                continue
            held.append(part)
            rows, size = rows + part.num_rows, size + part.get_total_buffer_size() * part.num_rows // max(batch.num_rows, 1)
            if rows < most_rows and size < most_bytes:
                continue
            table = pa.Table.from_batches(held)
            columns = [table.column(k) for k in keys]
            last = [c[-1] for c in columns]
            of_last = lambda i: all(c[i] == x for c, x in zip(columns, last))  # noqa: B023,E731
            cutoff, step = table.num_rows - 1, 1
            while cutoff > 0 and of_last(max(cutoff - step, 0)):  # gallop back over the open group
                cutoff, step = max(cutoff - step, 0), 2 * step
            low = max(cutoff - step, 0)
            while low < cutoff:  # its first row lies between a row that is not in it and one that is
                middle = (low + cutoff) // 2
                low, cutoff = (low, middle) if of_last(middle) else (middle + 1, cutoff)
            if cutoff:
                yield table.slice(0, cutoff).combine_chunks()
                rest = table.slice(cutoff).combine_chunks()
                held, rows, size = rest.to_batches(), rest.num_rows, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group of a table sorted by keys, and the number of rows."""
    if not table.num_rows:
        return np.zeros(1, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
