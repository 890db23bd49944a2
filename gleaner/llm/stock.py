"""Cutting-stock plans over a histogram of lengths: which patterns of lengths fill sequences, and how often.

Lengths are rounded up to bins of `width`. The linear program covers every bin's demand with the fewest patterns of
at most `capacity`. Its first basis comes from exhausting the histogram: the fullest pattern of what is left, as
often as it goes, uses up one bin each time. Columns are priced by a knapsack over the dual prices, and generated
until the plan is within `gap` of the tokens themselves, or no pattern is worth more than 1 + gap. Counts are rounded
down; what that leaves, a few documents a pattern however many there are in all, is covered by fullest patterns.

Within a bin documents are ranked by length, so that a pattern's sequences fall into runs in which every slot has
one exact length. As documents may be cut, the rooms that runs leave open are filled too: those with most room are
taken apart, and their tokens laid end to end fill the rooms of all others. What then remains makes full sequences,
and the last tokens, too few for one, make powers of two. Everything here has the size of the histogram, at most
`capacity` lengths; documents are only counted.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

GAP = 1e-3


class Knapsack:
    """The multisets of sizes within each room that are worth most, by dynamic programming over the rooms."""

    def __init__(self, sizes: np.ndarray, worth: np.ndarray, capacity: int):
        """sizes ascend"""
        self.sizes, self.worth, self.capacity = sizes, worth, capacity
        self.value, self.pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        value, fits = self.value, np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
        behind = [worth[:n] for n in range(len(sizes) + 1)]
        for room in range(1, capacity + 1):
            n, least = fits[room], value[room - 1]
            if n:
                got = behind[n] + value[room - sizes[:n]]
                k = got.argmax()
                if got[k] > least + 1e-12:
                    least, self.pick[room] = got[k], k
            value[room] = least

    def pattern(self, first: int) -> np.ndarray:
        """The pattern that is worth most of those with this size in them."""
        out, room = np.zeros(len(self.sizes), np.int64), self.capacity - int(self.sizes[first])
        out[first] = 1
        while room > 0:
            k = self.pick[room]
            if k >= 0:
                out[k] += 1
            room -= int(self.sizes[k]) if k >= 0 else 1
        return out

    def best(self) -> np.ndarray:
        """Worth of the best pattern with each size in it."""
        return self.worth + self.value[self.capacity - self.sizes]


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern of the largest size left and, again and again, the largest that still fits, no size oftener than left."""
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for k in np.flatnonzero(left > 0)[::-1].tolist():
        n = min(room // int(sizes[k]), int(np.ceil(left[k])))
        if n > 0:
            pattern[k] = n
            room -= n * int(sizes[k])
        if not room:
            break
    return pattern


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """By elimination, without a linear algebra library: on a driver its threads compete with Spark's, and matrices
    here are small."""
    n = len(basis)
    both = np.hstack([basis, np.eye(n)])
    for k in range(n):
        at = k + int(np.abs(both[k:, k]).argmax())
        if at != k:
            both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[k]
    return both[:, n:]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 100) -> list[tuple[np.ndarray, float]]:
    """(pattern, how often) of the linear program within `gap` of its optimum; sizes ascend, demand is positive."""
    n = len(sizes)
    left, basis = demand + 1e-6 * np.sqrt(np.arange(2, n + 2)), np.zeros((n, n))  # so that sizes run out one at a time
    for k in range(n):  # a column holds the size that it uses up, and later ones don't: the basis can be inverted
        pattern = fullest(sizes, left, capacity)
        used = np.flatnonzero(pattern)
        times = left[used] / pattern[used]
        basis[:, k] = pattern
        left -= times.min() * pattern
        left[used[int(times.argmin())]] = 0
    inverse = inverse_of(basis)
    x = np.maximum((inverse * demand).sum(axis=1), 0)
    least_sum = (1 + gap) * float((sizes * demand).sum()) / capacity
    for _ in range(rounds):
        if x.sum() <= least_sum:  # no plan needs less than the tokens themselves
            break
        price = np.maximum(inverse.sum(axis=0), 0)
        priced = Knapsack(sizes, price, capacity)
        worth = priced.best()
        if worth.max() <= 1 + gap:
            break
        for first in np.argsort(-worth).tolist():  # one table prices a column for each size
            if worth[first] <= 1 + gap:
                break
            pattern = priced.pattern(first)
            held = np.flatnonzero(pattern)
            if (price[held] * pattern[held]).sum() <= 1 + gap / 2:
                continue  # the columns before have made it cheap
            move = (inverse[:, held] * pattern[held]).sum(axis=1)
            ok = move > 1e-7
            if not ok.any():
                continue
            ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
            least = ratio.min()
            out = int(np.where(ratio <= least + 1e-9, move, 0).argmax())  # of ties the one that keeps the basis sound
            x = np.maximum(x - least * move, 0)
            x[out] = least
            basis[:, out] = pattern
            row = inverse[out] / move[out]
            move[out] -= 1
            inverse -= move[:, None] * row[None, :]
            price = np.maximum(inverse.sum(axis=0), 0)
        inverse = inverse_of(basis)
        x = np.maximum((inverse * demand).sum(axis=1), 0)
    return [(basis[:, k].astype(np.int64), float(x[k])) for k in range(n) if x[k] > 1e-9]


@dataclass
class Plan:
    """Where the document of a length and rank goes. `slots`: (length, first rank, documents, sequence of the first,
    offset; or -1 and the place of the first in the stream of tokens that fills rooms). `rooms`: (place in the
    stream, size, how many, sequence of the first, offset). `sequences`: how many there are."""

    slots: list[tuple[int, int, int, int, int]]
    rooms: list[tuple[int, int, int, int, int]]
    sequences: int


def _patterns(counts: dict[int, int], capacity: int, width: int, gap: float) -> list[tuple[list[int], int]]:
    """(bins of a pattern, how often), whole numbers that cover every document once at least as exactly as bins tell."""
    bins, demand = np.unique([-(-x // width) for x in counts], return_inverse=True)
    demand = np.bincount(demand, weights=[float(n) for n in counts.values()])
    left, out = np.rint(demand).astype(np.int64), []
    for pattern, times in solve(bins, demand, capacity // width, gap):
        times = min(int(times + 1e-9), *(int(left[k] // pattern[k]) for k in np.flatnonzero(pattern)))
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    while left.any():
        pattern = fullest(bins, left, capacity // width)
        times = min(int(left[k] // pattern[k]) for k in np.flatnonzero(pattern))
        left -= times * pattern
        out.append((pattern, times))
    return [([int(bins[k]) for k in np.flatnonzero(p)[::-1] for _ in range(int(p[k]))], n) for p, n in out]


def plan(counts: dict[int, int], capacity: int, width: int = 4, gap: float = GAP) -> Plan:
    """counts: documents of each length, 1 to capacity - 1."""
    if not counts:
        return Plan([], [], 0)
    of_bin: dict[int, list[list[int]]] = {}
    for length in sorted(counts):  # the longest of a bin go first
        of_bin.setdefault(-(-length // width), []).append([length, 0, counts[length]])
    runs: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, (length, first rank) of each slot)
    for bins, times in _patterns(counts, capacity, width, gap):
        slots = []
        for b in bins:
            need, got = times, []
            while need:
                length, rank, there = of_bin[b][-1]
                n = min(need, there)
                got.append((n, length, rank))
                of_bin[b][-1][1:] = [rank + n, there - n]
                need -= n
                if n == there:
                    of_bin[b].pop()
            slots.append(got)
        done = 0
        while done < times:  # up to the next change of any slot's length
            n = min(got[0][0] for got in slots)
            runs.append((n, [(length, rank) for (_, length, rank), *_ in slots]))
            slots = [[(m - n, length, rank + n), *rest] if m > n else rest for (m, length, rank), *rest in slots]
            done += n
    room = lambda run: capacity - sum(x for x, _ in run[1])
    runs.sort(key=room)
    open_, stream = sum(n * room((n, slots)) for n, slots in runs), 0
    apart: list[tuple[int, list[tuple[int, int]]]] = []
    while runs and open_ > stream:
        n, slots = runs.pop()
        free = room((n, slots))
        take = min(n, -(-(open_ - stream) // capacity))
        apart.append((take, [(length, rank + n - take) for length, rank in slots]))
        open_, stream = open_ - take * free, stream + take * (capacity - free)
        if take < n:
            runs.append((n - take, slots))
    out, rooms, sequence, place = [], [], 0, 0
    for n, slots in runs:
        offset = 0
        for length, rank in slots:
            out.append((length, rank, n, sequence, offset))
            offset += length
        if offset < capacity:
            rooms.append((place, capacity - offset, n, sequence, offset))
            place += n * (capacity - offset)
        sequence += n
    rest = stream - place
    if rest >= capacity:
        rooms.append((place, capacity, rest // capacity, sequence, 0))
        place, sequence = place + rest // capacity * capacity, sequence + rest // capacity
    for power in (1 << k for k in reversed(range(capacity.bit_length()))):
        if (stream - place) & power and power < capacity:
            rooms.append((place, power, 1, sequence, 0))
            place, sequence = place + power, sequence + 1
    at = 0
    for n, slots in apart:
        for length, rank in slots:
            out.append((length, rank, n, -1, at))
            at += n * length
    return Plan(out, rooms, sequence)


class Places:
    """A plan, ready to be asked for many documents."""

    RANKS = 1 << 44

    def __init__(self, plan: Plan):
        slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 5)
        self.key = slots[:, 0] * self.RANKS + slots[:, 1]
        self.length, self.rank, _, self.sequence, self.at = slots.T
        self.rooms = plan.rooms
        self.room_at = [r[0] for r in plan.rooms]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each document, or (-1, place in the stream)."""
        k = np.searchsorted(self.key, length * self.RANKS + rank, side="right") - 1
        nth, whole = rank - self.rank[k], self.sequence[k] >= 0
        return np.where(whole, self.sequence[k] + nth, -1), self.at[k] + np.where(whole, 0, nth * length)

    def cuts(self, at: int, length: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the pieces of a document that lies at this place of the stream."""
        out, end = [], at + length
        while at < end:
            start, size, _, sequence, offset = self.rooms[bisect_right(self.room_at, at) - 1]
            nth, into = divmod(at - start, size)
            n = min(end - at, size - into)
            out.append((n, sequence + nth, offset + into))
            at += n
        return out
