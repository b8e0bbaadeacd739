"""What a Python worker keeps from one task to the next: one object at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_KEPT: dict = {}


def kept(key, make: Callable):
    """The object made for the key; that of another key is let go first, so a worker's memory holds one."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class Codes(dict):
    """Numbers of keys; a key not met before gets the next number and is put on the list `new`."""

    def __init__(self, first: int = 0):
        self.next, self.new = first, []

    def __missing__(self, key):
        self[key] = code = self.next
        self.next += 1
        self.new.append(key)
        return code


class Runs:
    """Id sequences by number, laid end to end in one array."""

    def __init__(self):
        self.flat, self.n, self.count = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append sequences: their ids end to end, and their lengths."""
        while self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.n : self.n + len(ids)] = ids
        new = slice(self.count, self.count + len(lengths))
        self.start[new] = self.n + np.cumsum(lengths) - lengths
        self.length[new] = lengths
        self.n, self.count = self.n + len(ids), self.count + len(lengths)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered sequences, end to end; their lengths)."""
        return gather(self.flat, self.start[codes], self.length[codes]), self.length[codes]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start+length] of all ranges, end to end."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
