"""Cutting stock: the linear program over packing patterns, solved by column generation."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

import numpy as np

#: Pricing also ends once so many rounds together have gained less than a thousandth of a sequence.
PATIENCE = 60


def best_pattern(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack by dynamic programming: (value, {item: copies}) of the dearest pattern within capacity."""
    by_length = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1)
    for i in np.argsort(price, kind="stable"):
        if price[i] > by_length[lengths[i]]:
            by_length[lengths[i]], item[lengths[i]] = price[i], i
    used = np.flatnonzero(item >= 0)
    if not len(used):
        return 0.0, {}
    worth = by_length[used]
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(int(used[0]), capacity + 1):
        n = np.searchsorted(used, c, "right")
        total = worth[:n] + value[c - used[:n]]
        k = int(total.argmax())
        if total[k] > value[c - 1] + 1e-12:
            value[c], choice[c] = total[k], used[k]
        else:
            value[c] = value[c - 1]
    copies: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            i = int(item[choice[c]])
            copies[i] = copies.get(i, 0) + 1
            c -= int(choice[c])
    return float(value[capacity]), copies


def first_basis(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """One pattern for each length, the amounts that meet ``need`` exactly, and the order in which lengths were met.

    Each pattern takes the longest lengths still needed that fit, or at last the one that fits exactly, and is used
    until one of its lengths is met; that length is in no later pattern. So the basis is triangular.
    """
    left, open_, of_length = need.copy(), list(range(len(lengths))), {int(x): i for i, x in enumerate(lengths)}
    patterns: list[dict[int, int]] = [{} for _ in lengths]
    amount, order = np.zeros(len(lengths)), []
    sizes = [int(x) for x in lengths]
    while open_:
        room, at, pattern = capacity, len(open_), {}
        while room:
            exact = of_length.get(room)
            if exact is not None and left[exact] > 0 and exact not in pattern:
                pattern[exact] = 1
                break
            at = bisect_right(open_, room, 0, at, key=sizes.__getitem__)
            if not at:
                break
            at -= 1
            i = open_[at]
            pattern[i] = max(1, min(room // sizes[i], int(left[i])))
            room -= pattern[i] * sizes[i]
        met = min(pattern, key=lambda i: left[i] / pattern[i])
        n = left[met] / pattern[met]
        for i, k in pattern.items():
            left[i] = max(0.0, left[i] - k * n)
        left[met] = 0.0
        patterns[met], amount[met] = pattern, n
        open_.remove(met)
        order.append(met)
    return patterns, amount, order


Start = Callable[[np.ndarray, np.ndarray, int], tuple[list[dict[int, int]], np.ndarray, list[int]]]


def plain_basis(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """One pattern for each length, of as many copies of it as fit: the plainest start."""
    copies = capacity // lengths
    return [{i: int(k)} for i, k in enumerate(copies)], need / copies, list(range(len(lengths)))


def triangular_inverse(patterns: list[dict[int, int]], order: list[int]) -> np.ndarray:
    """Inverse of the basis whose j-th column is ``patterns[j]``, by forward substitution in the order of meeting."""
    users: list[list[tuple[int, int]]] = [[] for _ in patterns]
    for j in order:
        for i, k in patterns[j].items():
            users[i].append((j, k))
    inverse = np.zeros((len(patterns), len(patterns)))
    for j in order:
        row = inverse[j]
        row[j] = 1.0
        for other, k in users[j]:
            if other != j:
                row -= k * inverse[other]
        row /= patterns[j][j]
    return inverse


def solve(demand: dict[int, int], capacity: int, start: Start = first_basis) -> list[tuple[dict[int, int], float]]:
    """Patterns ({length: copies}, amount) that together hold ``demand`` ({length: pieces}) at the least amount.

    Revised simplex with an explicit inverse of the basis, from the patterns of ``start``. Each round prices all
    patterns at once by a knapsack over the dual prices and brings the dearest into the basis. It ends when no pattern
    costs more than 1, so that none can lower the amount; or when the amount is no more than the sequences that any
    packing into whole sequences needs: the proven bound, rounded up. The bound is the tokens over ``capacity`` or, where
    the best price is v, the amount over v. Degenerate programs can turn in place for long, so PATIENCE ends them too.
    Rows are lengths, at most ``capacity``, whatever the number of documents.
    """
    lengths = np.array(sorted(x for x, n in demand.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    need = np.array([demand[int(x)] for x in lengths], np.float64)
    m = len(lengths)
    patterns, amount, order = start(lengths, need, capacity)
    inverse = triangular_inverse(patterns, order)
    bound, duals = float(need @ lengths) / capacity, inverse.sum(0)
    totals: list[float] = []
    while True:
        total = amount.sum()
        if total <= math.ceil(bound - 1e-6) + 1e-6:
            break
        totals.append(total)
        if len(totals) > PATIENCE and totals[-1 - PATIENCE] - total < 1e-3:
            break
        value, copies = best_pattern(duals, lengths, capacity)
        bound = max(bound, total / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        at = np.fromiter(copies, np.int64, len(copies))
        column = inverse[:, at] @ np.fromiter(copies.values(), np.float64, len(copies))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, amount / column, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        pivot = inverse[out] / column[out]
        rows = np.flatnonzero(np.abs(column) > 1e-12)
        inverse[rows] -= np.outer(column[rows], pivot)
        inverse[out] = pivot
        amount -= step * column
        amount[out] = step
        np.maximum(amount, 0, out=amount)
        duals -= (column.sum() - 1) * pivot  # they are the column sums of the inverse
        patterns[out] = copies
    return [({int(lengths[i]): n for i, n in p.items()}, float(x)) for p, x in zip(patterns, amount, strict=True) if x > 1e-9]


def whole_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole amounts that hold ``demand`` exactly.

    Amounts of the program are rounded down, and one more of each pattern is taken, largest fraction first, where its
    pieces are still there. What then remains is a program of its own, with fewer pieces; and so on. Where no pattern
    fits, as when it takes more copies of a length than there are, the first is cut down to what there is.
    """
    left = {x: n for x, n in demand.items() if n > 0}
    chosen: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], n: int) -> None:
        chosen.append((pattern, n))
        for x, k in pattern.items():
            left[x] -= k * n
            if not left[x]:
                del left[x]

    while left:
        found = solve(left, capacity)
        before = len(chosen)
        for pattern, amount in found:
            if n := int(amount + 1e-7):
                take(pattern, min(n, *(left.get(x, 0) // k for x, k in pattern.items())))
        for pattern, amount in sorted(found, key=lambda f: int(f[1] + 1e-7) - f[1]):
            if amount - int(amount + 1e-7) > 1e-7 and all(left.get(x, 0) >= k for x, k in pattern.items()):
                take(pattern, 1)
        if len(chosen) == before:
            pattern = max(found, key=lambda f: f[1])[0]
            take({x: min(k, left[x]) for x, k in pattern.items()}, 1)
    return [(pattern, n) for pattern, n in chosen if n]


def dissolve(patterns: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The patterns without the least filled sequences, as many as it takes for their tokens to fill all the others."""
    filled = [sum(x * k for x, k in p.items()) for p, _ in patterns]
    free = sum(n * (capacity - f) for (_, n), f in zip(patterns, filled, strict=True))
    gone = -(-free // capacity)
    out = []
    for i in sorted(range(len(patterns)), key=lambda i: (filled[i], sorted(patterns[i][0].items()))):
        pattern, n = patterns[i]
        cut = min(n, gone)
        gone -= cut
        if n > cut:
            out.append((pattern, n - cut))
    return out
