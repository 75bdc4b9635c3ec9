"""A bounded store of what distinct words encode to, looked up by 64-bit hash."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: New words are kept apart, in a small sorted list, until so many have come together.
RECENT = 1 << 16


class _Growing:
    """An array that is added to: its room doubles, so adding costs what is added."""

    def __init__(self, kind: type, first: list[int]):
        self.room, self.n = np.zeros(1024, kind), 0
        self.add(np.array(first, kind))

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            grown = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            grown[: self.n] = self.room[: self.n]
            self.room = grown
        self.room[self.n : end] = values
        self.n = end


class Known:
    """Sorted hashes, and for each the ids in one flat array."""

    def __init__(self, remember: int):
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.recent, self.recent_place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.flat = _Growing(np.int64, [0]), _Growing(np.uint32, [])

    @staticmethod
    def _found(sorted_hashes: np.ndarray, place: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(sorted_hashes):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
        return np.where(sorted_hashes[at] == wanted, place[at], -1)

    def ids(self, hashes: np.ndarray, make: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word).

        ``make`` gets the positions of one word of each new hash and encodes those.
        """
        if len(self.hashes) + len(self.recent) > self.remember:
            self.forget()
        distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._found(self.hashes, self.place, distinct)
        rest = np.flatnonzero(place < 0)
        place[rest] = self._found(self.recent, self.recent_place, distinct[rest])
        new = rest[place[rest] < 0]
        if len(new):
            got = make(one[new])
            place[new] = self.first.n - 1 + np.arange(len(got))
            self.first.add(self.flat.n + np.cumsum([len(x) for x in got]))
            self.flat.add(np.concatenate(got))
            at = np.searchsorted(self.recent, distinct[new])
            self.recent, self.recent_place = np.insert(self.recent, at, distinct[new]), np.insert(self.recent_place, at, place[new])
            if len(self.recent) > RECENT:
                at = np.searchsorted(self.hashes, self.recent)
                self.hashes, self.place = np.insert(self.hashes, at, self.recent), np.insert(self.place, at, self.recent_place)
                self.recent, self.recent_place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        which = place[inverse]
        begin = self.first.room[which]
        size = self.first.room[which + 1] - begin
        to = np.cumsum(size)
        return self.flat.room[np.repeat(begin - to + size, size) + np.arange(to[-1] if len(to) else 0)], size
