"""Bin packing of a histogram of lengths by linear grouping and column generation.

The input is how often each length 1..capacity occurs, so the work depends on the
capacity, never on the number of pieces. The output says, run by run, which lengths
share a bin and how many bins look like that:

1. full pieces are bins of their own;
2. lengths over `large` are cut into `groups` groups of equal cardinality and rounded up
   to the longest of their group;
3. a linear programme over bin configurations of the few rounded sizes is solved by
   column generation (the next configuration is a knapsack over the dual prices), its
   multiplicities are rounded down;
4. actual lengths take the places of their rounded sizes, longest first;
5. what is left over, and all small lengths, go where they fit best.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

Runs = list[tuple[tuple[int, ...], int]]  # lengths in a bin, number of such bins


def _knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the highest price within the capacity."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        value = best[room - sizes[fits]] + prices[fits]
        k = int(value.argmax())
        if value[k] > best[room - 1] + 1e-12:
            best[room], take[room] = value[k], fits[k]
        else:
            best[room], take[room] = best[room - 1], -2
    out = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0 and take[room] != -1:
        if take[room] == -2:
            room -= 1
            continue
        out[take[room]] += 1
        room -= sizes[take[room]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Fractional cover of the demand by few configurations (revised simplex)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        column = _knapsack(np.maximum(prices, 0), sizes, capacity).astype(float)
        if column @ prices <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        amount = np.maximum(amount - step * direction, 0)
        amount[leaves] = step
        basis[:, leaves] = column
    return [(basis[:, j].astype(np.int64), float(amount[j])) for j in range(k)]


class _Bins:
    """Runs of equal bins by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.rooms: list[int] = []

    def add(self, items: tuple[int, ...], count: int) -> None:
        room = self.capacity - sum(items)
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((items, count))

    def place(self, size: int, count: int) -> None:
        """Best fit of `count` pieces of one size, run by run."""
        while count:
            at = bisect_left(self.rooms, size)
            if at == len(self.rooms):
                each = self.capacity // size
                if count >= each:
                    self.add((size,) * each, count // each)
                    count %= each
                if count:
                    self.add((size,) * count, 1)
                return
            room = self.rooms[at]
            items, bins = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            each = min(room // size, count)
            used = min(bins, count // each)
            if used < bins:
                self.add(items, bins - used)
            self.add(items + (size,) * each, used)
            count -= used * each

    def runs(self) -> Runs:
        return [run for room in self.rooms for run in self.by_room[room]]


def pack_histogram(counts: dict[int, int], capacity: int, large: int | None = None, groups: int = 40,
                   slack: int = 8) -> Runs:
    """Runs that hold every piece of `counts` (length -> number of pieces) exactly once.

    Lengths outside 1..capacity are an error. An empty histogram gives no runs.
    """
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    large = capacity // 8 if large is None else large
    left = {length: n for length, n in counts.items() if n > 0}
    runs: Runs = []
    if left.get(capacity):
        runs.append(((capacity,), left.pop(capacity)))
    bins = _Bins(capacity)
    loose: dict[int, int] = {}  # pieces of bins that rounding left too much room in
    long = sorted((length for length in left if length > large), reverse=True)
    if long:
        number = np.array([left[length] for length in long])
        # Equal cardinality: the group of a length is where the middle of its pieces falls.
        middle = np.cumsum(number) - number / 2
        group = np.minimum((middle * groups / number.sum()).astype(int), groups - 1)
        labels = np.unique(group)
        members = [[length for length, g in zip(long, group) if g == label] for label in labels]
        sizes = np.array([m[0] for m in members])
        demand = np.array([sum(left[length] for length in m) for m in members], float)
        for pattern, amount in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            slots = [k for k in np.flatnonzero(pattern) for _ in range(pattern[k])]
            bins_left = int(amount + 1e-9)
            while bins_left and slots:
                lengths, used = [], bins_left
                free = {length: left[length] for k in set(slots) for length in members[k] if left.get(length)}
                for k in slots:
                    pick = next((length for length in members[k] if free.get(length, 0) > 0), None)
                    if pick is None:
                        break
                    lengths.append(pick)
                    free[pick] -= 1
                if len(lengths) < len(slots):
                    break
                for length in set(lengths):
                    used = min(used, left[length] // lengths.count(length))
                for length in lengths:
                    left[length] -= used
                if capacity - sum(lengths) <= slack:
                    runs.append((tuple(lengths), used))
                else:
                    for length in lengths:
                        loose[length] = loose.get(length, 0) + used
                bins_left -= used
    for length, n in loose.items():
        left[length] += n
    for length in sorted(left, reverse=True):
        if left[length]:
            bins.place(length, left[length])
    return runs + bins.runs()
