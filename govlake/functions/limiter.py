"""The counters of the rate limiter, advanced tick by tick.

All requests of one key within one clock tick see the same clock, so their number is all
the counters need; that keeps the ordered work per key bounded by the length of the log
in ticks, however many requests a key makes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MICROS = 1_000_000


def fresh(windows: Sequence[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Counters and expiry times of a key not seen before."""
    return [0] * len(windows), [0] * len(windows)


def advance(tick: int, requests: int, windows: Sequence[tuple[int, int]],
            counts: list[int], expires: list[int]) -> list[int]:
    """Requests of one tick that pass each window, in window order; updates the counters.

    ``windows`` are (time to live in micros, limit). A counter is forgotten once its time
    to live has passed since the last request it counted. What passes one window is
    counted there even if a later window turns it away.
    """
    passed = []
    left = requests
    for i, (ttl, limit) in enumerate(windows):
        if left > 0:
            if tick >= expires[i]:
                counts[i] = 0
            left = min(left, max(limit - counts[i], 0))
            if left > 0:
                counts[i] += left
                expires[i] = tick + ttl
        passed.append(left)
    return passed


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new key begins; keys are not null."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = True
    for k in keys:
        column = batch.column(k)
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def fold_sorted(batches: Iterable[pa.RecordBatch], keys: Sequence[str],
                windows: Sequence[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Add ``passed`` to batches of (keys, tick, requests) sorted by keys and tick.

    A key that begins and ends inside a batch with no more requests than the smallest
    limit passes as a whole; only the others are walked tick by tick.
    """
    smallest = min(limit for _, limit in windows)
    current, counts, expires = None, [], []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        requests = batch.column("requests").to_numpy()
        ticks = batch.column("tick").to_numpy()
        starts = _starts(batch, keys)
        ends = np.append(starts[1:], batch.num_rows)
        passed = np.repeat(requests[:, None], len(windows), axis=1)
        walked = np.add.reduceat(requests, starts) > smallest
        walked[[0, -1]] = True  # these may continue the batch before or go on in the next
        for group in np.flatnonzero(walked):
            start, end = int(starts[group]), int(ends[group])
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if key != current:
                current = key
                counts, expires = fresh(windows)
            passed[start:end] = [
                advance(t, n, windows, counts, expires)
                for t, n in zip(ticks[start:end].tolist(), requests[start:end].tolist())
            ]
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(windows)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(passed.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "passed"])
