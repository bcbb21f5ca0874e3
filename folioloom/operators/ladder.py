"""The rungs on titles for one agenda in memory: documents stream past it once, and each is read once, whatever the number of items.

A string is in a text only if its head is: the first eight bytes of its UTF-8, or four, two or one, if it has no more. So the bytes of a text
are taken as numbers of these sizes in numpy and looked up among the heads, and only strings whose head was found are searched for. The similarity
of two titles is bounded from above by what their characters and pairs of characters have in common, and by their longest common subsequence, which
is found for a block of titles at once, those that the other bounds leave; only titles that may reach the least ratio go to the matcher.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

GRAM = 8
#: Characters of texts that are hashed at a time, unless one text alone is longer.
AT_ONCE = 1 << 17
#: Titles whose common subsequence with a text is found at once.
TOGETHER = 24
_MIX = np.random.default_rng(5).integers(1 << 60, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def head_size(n: int) -> int:
    """The largest gram that ``n`` characters or bytes have."""
    return min(1 << n.bit_length() - 1, GRAM)


def gram_hashes(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n-grams at each start) for n = 1, 2, 4, 8 up to ``most``; each is made of two of half the size."""
    half = codes.astype(np.uint64) * _MIX[0]
    n = 1
    while n <= most and len(half):
        yield n, half
        half = half[:-n] * _MIX[n // 2 + 1] + (half[n:] ^ (half[n:] >> np.uint64(29))) * _MIX[n // 2]
        n *= 2


class Strings:
    """Finds which of some strings, each not empty, a text contains."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        raw = [bytes_of(s) for s in strings]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        by_head: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, r in enumerate(raw):
            n = head_size(len(r))
            by_head[n][int.from_bytes(r[:n], "little")].append(k)
        self.sizes = {}
        for n, members in by_head.items():
            heads = np.array(sorted(members), f"<u{n}")
            bits = min(_bits(len(heads)), 8 * n)
            mix, top = heads.dtype.type(_MIX[0] >> np.uint64(64 - 8 * n) | np.uint64(1)), heads.dtype.type(8 * n - bits)
            bitmap = np.zeros(1 << bits, bool)
            bitmap[heads * mix >> top] = True
            number = np.array([len(members[int(h)]) for h in heads])
            order = np.array([k for h in heads for k in members[int(h)]])
            tails = np.array([int.from_bytes(raw[k][-n:], "little") for k in order], heads.dtype)
            self.sizes[n] = bitmap, mix, top, heads, number, np.cumsum(number) - number, order, tails

    def found(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the strings in each text."""
        out: list[list[int]] = [[] for _ in texts]
        raw = [bytes_of(t) for t in texts]
        ends, joined = np.cumsum([len(r) + 1 for r in raw]) - 1, b"\0".join(raw)
        for n, (bitmap, mix, top, heads, number, starts, order, tails) in self.sizes.items():
            if len(joined) < n:
                continue
            grams = np.ndarray(len(joined) - n + 1, heads.dtype, joined, strides=(1,))
            at = np.flatnonzero(bitmap[(grams * mix >> top).astype(np.intp, copy=False)])
            head = np.minimum(np.searchsorted(heads, grams[at]), len(heads) - 1)
            true = heads[head] == grams[at]
            at, head = at[true], head[true]
            where = np.searchsorted(ends, at)
            if whole := number[head].sum() <= 4 * len(joined):
                # a place for each string with that head; one of fewer bytes than two heads is there if its tail is
                each = np.repeat(np.arange(len(at)), number[head])
                place = np.arange(len(each)) - np.repeat(np.cumsum(number[head]) - number[head], number[head]) + starts[head[each]]
                last = at[each] + self.lengths[order[place]] - n
                ends_here = last + n <= ends[where[each]]
                each, place, last = each[ends_here], place[ends_here], last[ends_here]
                true = grams[last] == tails[place]
                keys = np.unique(where[each[true]] * len(self.strings) + order[place[true]])
            else:
                heads_of = np.unique(where * len(heads) + head)
                keys = np.concatenate([key // len(heads) * len(self.strings) + order[starts[g] : starts[g] + number[g]] for key in heads_of for g in [key % len(heads)]])
            sure = whole & (self.lengths[keys % len(self.strings)] < 2 * n)
            for key, known in zip(keys.tolist(), sure.tolist(), strict=True):
                t, k = divmod(key, len(self.strings))
                if known or self.strings[k] in texts[t]:
                    out[t].append(k)
        return out


def _bits(n: int) -> int:
    """Size of a bitmap of ``n`` hashes: sparse, and small enough for a processor's cache while they are few."""
    return min(max(n.bit_length() + 5, 16), 26)


class Inside:
    """Finds which of some titles contain a text."""

    def __init__(self, titles: list[str]) -> None:
        self.titles, self.most = titles, max(map(len, titles), default=0)
        bits = _bits(sum(map(len, titles)))
        self.top = np.uint64(64 - bits)
        self.bitmaps = {1 << k: np.zeros(1 << bits, bool) for k in range(GRAM.bit_length())}
        for t in titles:
            for n, h in gram_hashes(codes_of(t), GRAM):
                self.bitmaps[n][h >> self.top] = True

    def holders(self, text: str) -> list[int]:
        if not text or len(text) > self.most:
            return []
        n = head_size(len(text))
        *_, (_, h) = gram_hashes(codes_of(text), n)
        return [k for k, t in enumerate(self.titles) if text in t] if self.bitmaps[n][h >> self.top].all() else []


def _pairs_of(codes: np.ndarray) -> np.ndarray:
    return np.bincount((codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(40503)) >> np.uint32(22), minlength=1024).astype(np.int16)


def _masks(title: str) -> dict[str, int]:
    """For each character the bits of its places."""
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(title):
        masks[c] |= 1 << k
    return dict(masks)


class Block:
    """The longest common subsequences of a few titles with a text, all of them at a time in the bits of one number.

    A title has a bit a character; the bit behind them stays empty, so that no sum carries over into the next title.
    """

    def __init__(self, titles: list[str], masks_of: Callable[[str], dict[str, int]] = _masks) -> None:
        self.full, self.places, at = 0, [], 0
        for title in titles:
            self.places.append((at, (1 << len(title)) - 1, masks_of(title)))
            self.full |= self.places[-1][1] << at
            at += len(title) + 1

    def in_common(self, text: str, numbers: Iterable[int]) -> list[int]:
        """Lengths for the titles with these numbers."""
        masks = {}
        for c in set(text):
            mask = 0
            for at, _, own in self.places:
                if c in own:
                    mask |= own[c] << at
            if mask:
                masks[c] = mask
        v = full = self.full
        for mask in [masks[c] for c in text if c in masks]:
            if u := v & mask:
                v = ((v + u) | (v ^ u)) & full
        return [ones.bit_count() - (v >> at & ones).bit_count() for at, ones, _ in map(self.places.__getitem__, numbers)]


class Alike:
    """Finds the titles whose sequence ratio with a text is ``least`` or more.

    With M matched characters of S in all, the ratio is 2M / S. No more characters can match than both have. A match of M characters in
    k blocks has M - k adjacent pairs that both have. Between two blocks lies an unmatched character at least, so
    k <= S - 2M + 1; and in a text of 200 characters or more the matcher begins a block, but for one at both starts, only at a character
    that is at most 1 % of it, so k is at most the number of those that both have, and one. What is matched is also a common subsequence.
    """

    def __init__(self, titles: list[str], least: float) -> None:
        self.order = sorted(range(len(titles)), key=lambda k: len(titles[k]))
        self.titles, self.least = [titles[k] for k in self.order], least
        self.lengths = np.array([len(t) for t in self.titles], np.int64)
        self.masks_of = lru_cache(1024)(_masks)
        coded = [codes_of(t) for t in self.titles]
        self.letters = np.array([np.bincount(c & np.uint32(63), minlength=64) for c in coded], np.int16).reshape(-1, 64)
        self.pairs = np.array([_pairs_of(c) for c in coded], np.int16).reshape(-1, 1024)

    def candidates(self, text: str) -> np.ndarray:
        """Places in ``titles`` that the bounds leave."""
        n, least = len(text), self.least
        shortest, longest = n * least / (2 - least) - 1e-6, n * (2 - least) / least + 1e-6
        if not self.titles or longest < len(self.titles[0]) or shortest > len(self.titles[-1]):
            return np.arange(0)
        lo, hi = np.searchsorted(self.lengths, [shortest, longest])
        at = np.arange(lo, hi)
        if not n or not len(at):
            return at[:0]
        codes = codes_of(text)
        counts = np.bincount(codes & np.uint32(63), minlength=64)
        both = np.minimum(self.letters[lo:hi], counts)
        total = self.lengths[lo:hi] + n
        stays = 2 * both.sum(1) >= least * total - 1e-6
        if n >= 200:
            every, times = np.unique(codes, return_counts=True)
            rare = np.zeros(64, bool)
            rare[every[times <= n // 100 + 1] & np.uint32(63)] = True
            seeds = both[:, rare].sum(1) + 1
        else:
            seeds = total
        at, total, seeds = at[stays], total[stays], seeds[stays]
        matched = np.ceil(least * total / 2 - 1e-6)
        blocks = np.minimum(total - 2 * matched + 1, seeds)
        shared = np.minimum(self.pairs[at], _pairs_of(codes)).sum(1) if len(at) else at
        return at[shared >= matched - blocks]

    def found(self, text: str) -> list[tuple[int, float]]:
        """(number of the title, ratio)."""
        out, matcher = [], None
        at = self.candidates(text).tolist()
        for some in (at[k : k + TOGETHER] for k in range(0, len(at), TOGETHER)):
            block = Block([self.titles[k] for k in some], self.masks_of)
            for k, common in zip(some, block.in_common(text, range(len(some))), strict=True):
                if 2 * common < self.least * (len(self.titles[k]) + len(text)) - 1e-6:
                    continue
                matcher = matcher or SequenceMatcher(None, "", text)
                matcher.set_seq1(self.titles[k])
                if (ratio := matcher.ratio()) >= self.least:
                    out.append((self.order[k], ratio))
        return out


def _highest(met: Iterable[tuple]) -> Iterable[tuple]:
    """Of (item_id, score, method) the one with the highest score for each item."""
    best: dict = {}
    for rung in met:
        if rung[0] not in best or best[rung[0]][1:] < rung[1:]:
            best[rung[0]] = rung
    return best.values()


def rungs(
    agenda: list[tuple], least: float | None, normalise: Callable[[str | None], str] | None = None, written: Iterable[tuple] = (), highest: bool = False
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Maps documents (file_id, dt) to (item_id, file_id, score, method) of every rung that holds, or, with ``highest``, of each item's highest.

    Other columns of the documents go along.

    ``agenda``: (item_id, title, tokens), no title empty. Without ``least`` only containment is looked at; with it also similarity from there on,
    and tokens. With ``normalise`` the documents' titles come raw, and are also compared with ``written``: (title as it is, item_id).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        titles: dict[str, list] = defaultdict(list)
        strings: dict[str, int] = {}
        users: dict[int, list[tuple]] = defaultdict(list)
        for item, title, tokens in agenda:
            titles[title].append(item)
            strings.setdefault(title, len(strings))
            for token in tokens if least is not None else ():
                users[strings.setdefault(token, len(strings))].append((item, len(tokens)))
        same: dict[str | None, list] = defaultdict(list)
        for title, item in written:
            same[title].append(item)
        known = list(titles)
        whole = {strings[t]: titles[t] for t in known}
        search, inside = Strings(list(strings)), Inside(known)
        alike = Alike(known, least) if least is not None else None

        def of(text: str, found: list[int]) -> Iterator[tuple]:
            held = {k for t in inside.holders(text) for k in titles[known[t]]}
            held.update(item for s in found if s in whole for item in whole[s])
            yield from ((item, 0.90, "title_contains") for item in held)
            if alike is None:
                return
            for t, ratio in alike.found(text):
                yield from ((item, 0.88 if ratio >= 0.9 else 0.75, "title_similarity") for item in titles[known[t]])
            hits: dict = defaultdict(int)
            for s in found:
                for user in users.get(s, ()):
                    hits[user] += 1
            yield from ((item, min(0.60 * n / of_all, 0.6), "keyword") for (item, of_all), n in hits.items())

        for batch in batches:
            texts, out = batch["dt"].tolist(), []
            part = np.cumsum([len(t or "") + 1 for t in texts]) // AT_ONCE
            for cut in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
                some = [normalise(texts[k]) if normalise else texts[k] for k in cut]
                for k, text, found in zip(cut.tolist(), some, search.found(some), strict=True):
                    met = chain(of(text, found), ((item, 0.95, "title_exact") for item in same.get(texts[k], ())))
                    out += ((item, k, score, method) for item, score, method in (_highest(met) if highest else met))
            if out:
                item, row, score, method = zip(*out, strict=True)
                other = {name: batch[name].to_numpy()[list(row)] for name in batch.columns if name not in ("dt", "file_id")}
                yield pd.DataFrame({"item_id": item, "file_id": batch["file_id"].to_numpy()[list(row)], "score": score, "method": method} | other)

    return run
