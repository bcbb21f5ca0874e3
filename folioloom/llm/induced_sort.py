"""Suffix arrays by induced sorting, and common prefixes of neighbouring suffixes in text order."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The end of the text is smaller than all, so the last suffix isn't."""
    step = np.sign(np.diff(text.astype(np.int64), append=-1))
    # equal neighbours take the type of the first that differs
    places = np.where(step != 0, np.arange(len(text)), len(text))
    return step[np.minimum.accumulate(places[::-1])[::-1]] > 0


def _deal(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, keys in that order, number of each within its key), the order by key being stable; ``count`` is 0, 1, 2, ..."""
    order = keys.argsort(kind="stable")
    keys = keys[order].astype(np.int64, copy=False)
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return order, keys, count[: len(keys)] - new.nonzero()[0][new.cumsum() - 1]


def _last(keys: np.ndarray) -> np.ndarray:
    """True for the last of each run of equal keys."""
    last = np.empty(len(keys), bool)
    last[-1] = True
    np.not_equal(keys[1:], keys[:-1], out=last[:-1])
    return last


_STRETCH = 1 << 16


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes (``seeds``) induce, in one scan up and one down.

    A scan goes over a stretch of the array at a time: the suffixes before those that stand there go to the next free places of
    their buckets, all together. Should one of these places lie in the stretch itself, only what stands before the
    first such place is done, and the scan goes on from there: so no suffix is passed over before it is in place.
    """
    n = len(text)
    count = np.arange(min(n, _STRETCH))
    sizes = np.bincount(text, minlength=width)
    ends = np.cumsum(sizes)
    out = np.full(n, -1, np.int64)
    share = np.bincount(text[seeds], minlength=width)
    out[np.arange(len(seeds)) + np.repeat(ends - np.cumsum(share), share)] = seeds
    head, tail = ends - sizes, ends.copy()
    out[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    at, step = 0, 1024
    while at < n:
        stop = min(n, at + step)
        place = (out[at:stop] > 0).nonzero()[0]
        found = out[at:stop][place] - 1
        fit = ~small[found]
        place, found = place[fit], found[fit]
        if len(found):
            order, keys, within = _deal(text[found], count)
            target = head[keys] + within
            if (first := int(target.min())) < stop:
                fine = place[order] < first - at
                order, keys, target, stop = order[fine], keys[fine], target[fine], first
            out[target] = found[order]
            last = _last(keys)
            head[keys[last]] = target[last] + 1
        at, step = stop, min(_STRETCH, max(256, 2 * (stop - at)))
    placed = (out >= 0).nonzero()[0]
    out[placed[small[out[placed]]]] = -1
    at, step = n, 1024
    while at > 0:
        stop = max(0, at - step)
        place = (out[stop:at] > 0).nonzero()[0][::-1]
        found = out[stop:at][place] - 1
        fit = small[found]
        place, found = place[fit], found[fit]
        if len(found):
            order, keys, within = _deal(text[found], count)
            target = tail[keys] - 1 - within
            if (last_place := int(target.max())) >= stop:
                fine = place[order] > last_place - stop
                order, keys, target, stop = order[fine], keys[fine], target[fine], last_place + 1
            out[target] = found[order]
            last = _last(keys)
            tail[keys[last]] = target[last]
        at, step = stop, min(_STRETCH, max(256, 2 * (at - stop)))
    return out


def _names(text: np.ndarray, marks: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the leftmost-smaller substrings in text order, equal ones alike; and how many there are."""
    n = len(text)
    at = np.full(n, -1, np.int64)
    at[marks] = np.arange(len(marks))
    lengths = np.append(np.diff(marks), n - marks[-1])  # up to the next mark; the last goes to the end of the text
    of = at[ranked]
    size = lengths[of]
    one, two = ranked[:-1], ranked[1:]
    same = size[:-1] == size[1:]
    same[(of[:-1] == len(marks) - 1) | (of[1:] == len(marks) - 1)] = False  # the end of the text is like nothing else
    live = np.flatnonzero(same)
    depth = 0
    while len(live):
        alike = text[one[live] + depth] == text[two[live] + depth]
        same[live[~alike]] = False
        live = live[alike]
        live = live[depth < size[live]]  # the next mark's character belongs to the substring
        depth += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(marks), np.int64)
    out[of] = name
    return out, int(name[-1]) + 1


def suffix_array(text: np.ndarray, width: int) -> np.ndarray:
    """Places of all suffixes of ``text`` (numbers under ``width``) in order; a suffix that another begins with is the smaller.

    Suffixes are classified as smaller or larger than the next; the leftmost-smaller substrings are sorted by inducing
    from their first characters, named, and where names repeat, the text of names is sorted in the same way, recursively;
    all other suffixes are induced from their order. Linear in the length but for the sorting within a stretch.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(marks):
        return _induce(text, small, marks, width)
    by_first = marks[np.argsort(text[marks], kind="stable")]
    order = _induce(text, small, by_first, width)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    ranked = order[is_mark[order]]
    names, many = _names(text, marks, ranked)
    if many < len(marks):
        ranked = marks[suffix_array(names, many)]
    return _induce(text, small, ranked, width)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of a text of bytes, how much its suffix has in common with the one before it in ``order``, ``most`` at most.

    Kept in text order, so all places are compared together, eight bytes at a time; those still alike go on.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    out = np.zeros(n, np.int64)
    live, depth = (before >= 0).nonzero()[0], 0
    other = before[live]
    while len(live) and depth < most:
        unlike = words[live + depth] ^ words[other + depth]
        alike = unlike == 0
        ends, bits = live[~alike], unlike[~alike]
        # the lowest bit that differs is in the first byte that does; a power of two is exact as a double
        out[ends] = depth + (np.log2((bits & (~bits + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3)
        live, other, depth = live[alike], other[alike], depth + 8
    out[live] = depth
    return np.minimum(np.minimum(out, most), np.where(before >= 0, n - np.maximum(before, np.arange(n)), 0))
