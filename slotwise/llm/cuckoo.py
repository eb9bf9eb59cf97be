"""A cuckoo filter over 64-bit keys: 16-bit marks, four per bucket, deletable."""

from __future__ import annotations

import numpy as np

_SLOTS, _KICKS = 4, 500


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class CuckooFilter:
    """No key that was added and not removed is ever missed; about 1 in 8,000 others is taken for one."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.mask = len(marks) - 1

    @classmethod
    def for_keys(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (_SLOTS * 0.8)))))
        while True:
            made = cls(np.zeros((buckets, _SLOTS), np.uint16))
            if made.add(keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def dump(self) -> bytes:
        return self.marks.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mixed(np.asarray(keys))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(self.mask)).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (_mixed(mark) & np.uint64(self.mask)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        return ((self.marks[first] == mark[:, None]) | (self.marks[second] == mark[:, None])).any(axis=1)

    def add(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be built anew, larger."""
        turn = np.random.default_rng(1)
        for mark, *places in zip(*self._places(keys)):
            if self._put(mark, places[0]) or self._put(mark, places[1]):
                continue
            at = places[turn.integers(2)]
            for _ in range(_KICKS):
                slot = turn.integers(_SLOTS)
                mark, self.marks[at, slot] = self.marks[at, slot], mark
                at = at ^ int(self._jump(np.array([mark], np.uint16))[0])
                if self._put(mark, at):
                    break
            else:
                return False
        return True

    def _put(self, mark: int, at: int) -> bool:
        for slot in range(_SLOTS):
            if self.marks[at, slot] == 0:
                self.marks[at, slot] = mark
                return True
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Only for keys that are in."""
        for mark, *places in zip(*self._places(keys)):
            for at in places:
                slots = np.flatnonzero(self.marks[at] == mark)
                if len(slots):
                    self.marks[at, slots[0]] = 0
                    break
