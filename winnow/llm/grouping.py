"""Bin packing of a histogram of lengths by linear grouping.

Large lengths are sorted and cut into groups of equal cardinality, and each group is rounded up to its largest
length. Configurations of these few sizes are optimised as a linear program by column generation, whose integer
part becomes bins. Actual lengths take the places of their groups' sizes, and whatever is left (small lengths,
and the large ones of the fractional part) is placed best-fit, longest first.

Everything works on counts of lengths, so cost and result size follow the capacity, not the number of items.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np

#: What is tried: the share of the capacity up to which lengths are small. A large share does best where lengths vary
#: much, a small one where they vary little.
SMALL = (1 / 3, 1 / 16)
MAX_GROUPS, MAX_PIVOTS = 512, 6000
_EPS = 1e-7


@dataclass(frozen=True)
class Bins:
    """``count`` bins that hold the same lengths: (length, copies) in order, from offset 0 without gaps."""

    count: int
    items: tuple[tuple[int, int], ...]


def linear_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[list[int]]]:
    """Runs [length, count], longest first, in at most ``groups`` groups of equal cardinality."""
    total = int(counts.sum())
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = size
    for length, n in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while n:
            if not room:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append([length, k])
            n, room = n - k, room - k
    return [g for g in out if g]


def _best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    use = [i for i in range(len(sizes)) if values[i] > _EPS]
    out = np.zeros(len(sizes))
    if not use:
        return 0.0, out
    size, value = np.array([sizes[i] for i in use]), values[use]
    # The smallest size is the width of a run of capacities whose best values depend on earlier runs alone, so each
    # run is one step. Capacities below 0 stand in front, and no item leads there.
    width, front = int(size.min()), int(size.max())
    best = np.full(front + (capacity // width + 1) * width, -np.inf)
    best[front : front + width] = 0.0
    last = np.full(len(best), -1, np.int32)
    earlier = np.lib.stride_tricks.sliding_window_view(best, width)
    for at in range(front + width, len(best), width):
        got = earlier[at - size] + value[:, None]
        pick = got.argmax(axis=0)
        best[at : at + width] = got[pick, np.arange(width)]
        last[at : at + width] = pick
    c = front + capacity
    while last[c] >= 0:
        out[use[last[c]]] += 1
        c -= int(size[last[c]])
    return float(best[front + capacity]), out


def _refined(inverse: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """One step of Newton's iteration, which squares what rounding has left of an error.

    Products alone: the library's own inversion, which factors in several threads, was seen to hang beside a JVM.
    """
    error = np.eye(len(basis)) - basis @ inverse
    return inverse + inverse @ error if np.abs(error).sum(axis=1).max() < 1 else inverse


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each (fractional) so that they cover ``demand`` with few bins."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / basis.diagonal())
    for pivot in range(MAX_PIVOTS):
        amount = np.maximum(inverse @ demand, 0)
        duals = inverse.sum(axis=0)
        value, column = _best_configuration(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 2e-4:  # a lower bound within so little
            break
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        if not len(rows):
            break
        leaves = rows[np.argmin(amount[rows] / direction[rows])]
        basis[:, leaves] = column
        row = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, row)
        inverse[leaves] = row
        if pivot % 100 == 99:
            inverse = _refined(inverse, basis)
    amount = np.maximum(_refined(inverse, basis) @ demand, 0)
    return [(basis[:, j], float(amount[j])) for j in range(m) if amount[j] > _EPS]


class _Free:
    """Open bins by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[Bins]] = defaultdict(list)
        self.full: list[Bins] = []
        self.open = np.zeros(capacity + 1, dtype=bool)

    def add(self, bins: Bins) -> None:
        room = self.capacity - sum(a * k for a, k in bins.items)
        if bins.count and room == 0:
            self.full.append(bins)
        elif bins.count:
            self.by_room[room].append(bins)
            self.open[room] = True

    def place(self, length: int, n: int) -> None:
        """Best fit: each item goes to the open bin with the least room that it fits, or to a new one."""
        while n:
            ahead = np.flatnonzero(self.open[length:])
            if len(ahead):
                room = length + int(ahead[0])
                bins = self.by_room[room].pop()
                self.open[room] = bool(self.by_room[room])
            else:
                room, bins = self.capacity, Bins(n, ())
            each = room // length
            filled = min(bins.count, n // each)
            self.add(Bins(filled, (*bins.items, (length, each))))
            n -= filled * each
            rest = bins.count - filled
            if rest and n and n < each:
                self.add(Bins(1, (*bins.items, (length, n))))
                rest, n = rest - 1, 0
            if bins.items:
                self.add(Bins(rest, bins.items))

    def all(self) -> list[Bins]:
        return self.full + [b for room in sorted(self.by_room) for b in self.by_room[room]]


def pack(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Bins]:
    """Bins that hold each length exactly as often as it is counted; lengths are from 1 to the capacity."""
    return min((_grouped(lengths, counts, capacity, small) for small in SMALL), key=lambda bins: sum(b.count for b in bins))


def _grouped(lengths: np.ndarray, counts: np.ndarray, capacity: int, small: float) -> list[Bins]:
    free = _Free(capacity)
    whole = lengths == capacity
    if counts[whole].sum():
        free.add(Bins(int(counts[whole].sum()), ((capacity, 1),)))
    large = (lengths > capacity * small) & ~whole
    groups = linear_groups(lengths[large], counts[large], min(MAX_GROUPS, 1 + int(counts[large].sum()) // 16)) if counts[large].sum() else []
    if groups:
        sizes = [g[0][0] for g in groups]
        # Groups that round up to one size are one row of the program.
        merged = sorted(set(sizes), reverse=True)
        queue = {s: deque(run for g in groups if g[0][0] == s for run in g) for s in merged}
        demand = np.array([sum(k for _, k in queue[s]) for s in merged], dtype=float)
        for column, amount in configurations(merged, demand, capacity):
            left = min([int(amount + 1e-9), *(int(sum(k for _, k in queue[merged[i]]) // column[i]) for i in np.flatnonzero(column))])
            slots = [merged[i] for i in np.flatnonzero(column) for _ in range(int(column[i]))]
            slots = slots[: max(1, len(slots) - 1)]  # the last stays free: rounding of the others adds to its room
            while left:
                # The longest lengths of each group take its places, as many bins at once as the runs allow.
                need: dict[int, int] = defaultdict(int)
                for s in slots:
                    need[s] += 1
                step = min([left, *(max(1, queue[s][0][1] // k) for s, k in need.items())])
                taken: dict[int, int] = defaultdict(int)
                for s, k in need.items():
                    if queue[s][0][1] >= k * step:
                        taken[queue[s][0][0]] += k
                        queue[s][0][1] -= k * step
                    else:  # step is 1: the places of this bin span two runs or more
                        for _ in range(k):
                            while not queue[s][0][1]:
                                queue[s].popleft()
                            taken[queue[s][0][0]] += 1
                            queue[s][0][1] -= 1
                    while queue[s] and not queue[s][0][1]:
                        queue[s].popleft()
                free.add(Bins(step, tuple(sorted(taken.items(), reverse=True))))
                left -= step
        rest: dict[int, int] = defaultdict(int)
        for runs in queue.values():
            for length, k in runs:
                rest[length] += k
    else:
        rest = defaultdict(int)
    for length, k in zip(lengths[~large & ~whole].tolist(), counts[~large & ~whole].tolist(), strict=True):
        rest[length] += k
    for length in sorted(rest, reverse=True):
        free.place(length, rest[length])
    return free.all()
