"""One window of the rate limiter over a bucket of ticks, as a transition of its counter.

The counter of a window is a pair: requests counted and the time it expires. A bucket's ticks
turn the counter that enters into the counter that leaves, and a counter that starts anew at a
tick doesn't depend on what was before. So where each fresh start leads to is worked out for all
ticks of a bucket at once, without the counter that enters; what can enter is small (counts
below the limit, and expiries less than a time to live away), and for that a table of what
leaves is kept. Tables of consecutive buckets are chained one lookup at a time, and with
the counter that enters known each bucket is decided on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A counter that has never counted.
NEVER = -(1 << 62)
FRESH = (0, NEVER)


@dataclass(frozen=True)
class Table:
    """What leaves a bucket: for a counter that starts anew at ``times[i]`` (count ``at_time[i][0]``,
    expiry ``at_time[i][1]``), and for one that enters with count ``c`` and goes on."""

    times: np.ndarray
    time_counts: np.ndarray
    time_expires: np.ndarray
    count_counts: np.ndarray
    count_expires: np.ndarray

    def leave(self, count: int, expires: int, limit: int) -> tuple[int, int]:
        if expires > self.times[0]:
            if count < limit:
                return int(self.count_counts[count]), int(self.count_expires[count])
            at = int(np.searchsorted(self.times, expires))
            if at == len(self.times):
                return count, expires
            return int(self.time_counts[at]), int(self.time_expires[at])
        return int(self.time_counts[0]), int(self.time_expires[0])


class Bucket:
    """Ascending ticks (micros) and their requests, under one (time to live, limit)."""

    def __init__(self, ticks: np.ndarray, requests: np.ndarray, ttl: int, limit: int) -> None:
        self.ticks, self.requests, self.ttl, self.limit = ticks, requests, ttl, limit
        n = len(ticks)
        self.upto = np.concatenate([[0], np.cumsum(requests)])
        gaps = np.flatnonzero(np.diff(ticks) >= ttl) + 1
        # The next start after a pause in which any counter expires, and the tick that fills a fresh counter.
        paused = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n), side="right")]
        filled = np.searchsorted(self.upto[1:], self.upto[:-1] + limit)
        full = filled < paused
        expiry = ticks[np.minimum(filled, n - 1)] + ttl
        self.next = np.where(full, np.searchsorted(ticks, expiry), paused)
        # The last start of the chain that begins at each tick, by doubling.
        last = np.where(self.next < n, self.next, np.arange(n))
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        self.out_counts = np.where(full, limit, self.upto[n] - self.upto[:-1])[last]
        self.out_expires = np.where(full, expiry, ticks[-1] + ttl)[last]
        self.first_pause = int(paused[0])

    def _start_after(self, count: int) -> tuple[int, int]:
        """First tick at which a counter that enters with ``count`` starts anew, and the place that fills it."""
        n = len(self.ticks)
        filled = int(np.searchsorted(self.upto[1:], self.limit - count))
        if filled < self.first_pause:
            return int(np.searchsorted(self.ticks, self.ticks[filled] + self.ttl)), filled
        return self.first_pause, n

    def table(self, begin: int) -> Table:
        """For counters that enter a bucket that begins at time ``begin``."""
        n = len(self.ticks)
        reach = min(n, int(np.searchsorted(self.ticks, begin + self.ttl)) + 1)
        counts, expires = np.empty(self.limit, np.int64), np.empty(self.limit, np.int64)
        for count in range(self.limit):
            start, filled = self._start_after(count)
            if start < n:
                counts[count], expires[count] = self.out_counts[start], self.out_expires[start]
            elif filled < n:
                counts[count], expires[count] = self.limit, self.ticks[filled] + self.ttl
            else:
                counts[count], expires[count] = count + self.upto[n], self.ticks[-1] + self.ttl
        return Table(self.ticks[:reach], self.out_counts[:reach], self.out_expires[:reach], counts, expires)

    def passed(self, count: int, expires: int) -> np.ndarray:
        """Requests of each tick that pass, for the counter that enters."""
        n = len(self.ticks)
        base = np.zeros(n, np.int64)  # requests before the start, less what the counter held then
        start = 0
        if expires > self.ticks[0]:
            if count < self.limit:
                start, _ = self._start_after(count)
                base[:start] = -count
            else:
                start = int(np.searchsorted(self.ticks, expires))
                base[:start] = -self.limit
        while start < n:
            end = int(self.next[start])
            base[start:end] = self.upto[start]
            start = end
        return np.clip(self.limit - (self.upto[:-1] - base), 0, self.requests)
