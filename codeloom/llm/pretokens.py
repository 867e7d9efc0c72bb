"""Token ids of texts, each distinct stretch between safe cuts encoded once.

Byte-level BPE never merges across pre-tokens, and a space with a character other than white space
on either side always begins a pre-token. A text split at its spaces thus has the ids of its parts
in order, and parts repeat: a bounded cache of two generations answers most of them. Where a part
is empty or begins or ends with white space the cut isn't safe, and the whole text goes through
the library.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

#: Parts in a generation of the cache; about 100 bytes each, two generations at most.
GENERATION = 240_000
BLOCK = 1 << 20


class _Parts(dict):
    """part -> ids as unsigned 32-bit integers; None where a cut isn't safe."""

    def __init__(self, encode: Callable[[str], list[int]], before: str, most: int):
        super().__init__()
        self.encode, self.before, self.most, self.old = encode, before, most, {}

    def __missing__(self, part: str) -> bytes | None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.pop(part, self)
        if found is self:
            found = array("I", self.encode(self.before + part)).tobytes() if part and part.strip() == part else None
        self[part] = found
        return found


class Encoder:
    """``encode`` gives the ids of any text; :meth:`ids` gives the same ids, faster.

    Texts with the string ``special`` go through ``whole`` instead.
    """

    def __init__(self, encode: Callable[[str], list[int]], special: str = "", whole: Callable[[str], list[int]] | None = None, generation: int | None = None):
        self.encode, self.special, self.whole = encode, special, whole
        most = generation or GENERATION
        self.first, self.rest = _Parts(encode, "", most), _Parts(encode, " ", most)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.whole and self.special in text:
            return np.asarray(self.whole(text), "<u4")
        try:
            return np.frombuffer(b"".join(self._blocks(text)), "=u4").astype("<u4", copy=False)
        except TypeError:  # a cut that isn't safe
            return np.asarray(self.encode(text), "<u4")

    def _blocks(self, text: str):
        get, at = self.rest.__getitem__, text.find(" ")
        yield self.first[text if at < 0 else text[:at]]
        while at >= 0:
            to = text.find(" ", at + BLOCK)
            block = text[at + 1 :] if to < 0 else text[at + 1 : to]
            yield b"".join(map(get, block.split(" ")))
            at = to
