"""Memo tables for tokenising: texts are cut where every tokenizer here must cut, and each piece is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable

#: Entries of one generation of a memo; a memo holds two generations at most.
MEMO = 250_000

_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


class Memo(dict):
    """A bounded memo: when a generation is full it becomes the old one, from which hits are carried over."""

    def __init__(self, make: Callable[[Hashable], object] | None = None, limit: int = MEMO):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old[key] if key in self._old else self._make(key)
        self.add(key, value)
        return value

    def add(self, key, value) -> None:
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value

    def absent(self, keys: set) -> list:
        """Those of ``keys`` in neither generation; hits of the old one are carried over."""
        missing = [k for k in keys if k not in self]
        if missing and (old := self._old):
            for key in missing:
                if key in old:
                    self[key] = old[key]
            missing = [k for k in missing if k not in self]
        return missing

    def room(self, n: int) -> None:
        """Turn the generation over now, if ``n`` more entries would overfill it."""
        if len(self) + n > self._limit:
            self._old = dict(self)
            self.clear()


def single_spaced(text: str) -> bool:
    """Whether every space stands before a character that isn't white space.

    Before such a space a byte-level pre-tokenizer always cuts: no token holds a space after another character, and a
    run of white space gives its last space to what follows. And nothing looks back across the cut.
    """
    return _LOOSE_SPACE.search(text) is None
