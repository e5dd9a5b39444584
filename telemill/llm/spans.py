"""Stretches of a text that don't overlap."""

from __future__ import annotations

from bisect import bisect_right


class Spans:
    """Takes a stretch if it overlaps none that was taken before; the time grows with the logarithm of their number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        if (k and self.ends[k - 1] > start) or (k < len(self.starts) and self.starts[k] < end):
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True
