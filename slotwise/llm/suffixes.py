"""Suffix arrays and common prefixes of many short strings, in numpy."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)]
    return out


class Suffixes:
    """The suffixes of all ``strings``, each ending in a mark of its own below any byte."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.cumsum(lengths)
        self.owner = np.repeat(np.arange(len(strings)), lengths)
        self.place = np.arange(len(self.data)) - np.repeat(self.ends - lengths, lengths)
        self.rest = np.repeat(lengths, lengths) - self.place
        self.words = _words(self.data)
        self.order, self.rank = self._sorted()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Larsson-Sadakane: ranks by the first 8 bytes, then 16, 32, ...; groups of one are done."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = np.minimum(self.rest, 8)
        first = self.words & ~((np.uint64(1) << ((8 - short) * 8).astype(np.uint64) % np.uint64(64)) - np.uint64(1))
        tie = np.where(self.rest <= 8, short * (len(self.ends) + 1) + self.owner, 9 * (len(self.ends) + 1))
        order = np.argsort(first)
        rank = np.empty(n, np.int64)
        slots = self._regroup(order, rank, np.arange(n), first[order])
        if len(slots):
            at = order[slots]
            key = rank[at] * (9 * (len(self.ends) + 1) + 1) + tie[at]
            by = np.argsort(key)
            order[slots] = at[by]
            slots = self._regroup(order, rank, slots, key[by])
        depth = 8
        while len(slots):
            at = order[slots]
            key = rank[at] * n + rank[at + depth]  # a suffix that ends within depth is alone in its group
            if n < 1 << 21:  # three numbers of 21 bits: sorting values is faster than sorting places by value
                key = np.sort((key << 21) | np.arange(len(at))) if len(at) else key
                by, key = key & ((1 << 21) - 1), key >> 21
            else:
                by = np.argsort(key)
                key = key[by]
            order[slots] = at[by]
            slots = self._regroup(order, rank, slots, key)
            depth *= 2
        return order, rank

    @staticmethod
    def _regroup(order: np.ndarray, rank: np.ndarray, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank what stands in ``slots`` by its sorted ``keys``; returns the slots of groups of several."""
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        return slots[~(new & np.append(new[1:], True))]

    def common(self) -> np.ndarray:
        """Per place, the bytes its suffix shares with the one before it in order (Kasai's array, by place).

        Where the bytes before the two suffixes agree, the value is that of the
        place before less one; only the others are compared.
        """
        n = len(self.data)
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        has = before >= 0
        follows = has & (self.place > 0) & (np.where(has, self.place[before], 0) > 0)
        i = np.flatnonzero(follows)
        same = np.zeros(n, bool)
        same[i] = (self.data[i - 1] == self.data[before[i] - 1]) & (before[i - 1] == before[i] - 1)
        at = np.flatnonzero(has & ~same)
        out = np.zeros(n, np.int64)
        a, b, most = at, before[at], np.minimum(self.rest[at], self.rest[before[at]])
        done = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            x = self.words[a[live] + done[live]] ^ self.words[b[live] + done[live]]
            full = x == 0
            equal = np.where(full, 8, 0)
            part = ~full
            # The first differing byte of the words.
            high = 63 - np.floor(np.log2(x[part].astype(np.float64) + 0.0)).astype(np.int64)
            lead = np.maximum(high, 0)
            lead -= (lead > 0) & ((x[part] >> (64 - lead).astype(np.uint64)) > 0)
            equal[part] = lead // 8
            done[live] += equal
            live = live[full & (done[live] < most[live])]
        out[at] = np.minimum(done, most)
        last = np.maximum.accumulate(np.where(~same, np.arange(n), 0))
        return np.where(same, out[last] - (np.arange(n) - last), out)

    def repeated(self, length: int) -> np.ndarray:
        """Per place, whether its first ``length`` bytes also start at another place."""
        common = self.common()
        next_ = np.zeros(len(common), np.int64)
        next_[self.order[:-1]] = common[self.order[1:]]
        return (self.rest >= length) & (np.maximum(common, next_) >= length)
