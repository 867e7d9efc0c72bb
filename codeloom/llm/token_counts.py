"""Edit-aware token counts on segment trees of pre-tokens.

A document's text is cut into leaves of whole pre-tokens, of about ``LEAF`` characters: at places where the
pattern of pre-tokens ends a match whatever surrounds them (before white space, and between a letter, a
number and another sign, in any script). A longer stretch without such a place, as a run of letters
without spaces, is one pre-token; it is cut inside, where one of its tokens ends. Each leaf knows its
characters and tokens, and a segment tree over the leaves sums both.

An edit finds the leaves that it touches by descending the tree, takes one more leaf on either side as
context, re-encodes that region only and updates the sums on the paths above. Where the region begins or
ends inside a pre-token, the tokens on either side of that place must be what byte-pair encoding makes of
the two together; a sequence of tokens whose neighbours all pass this is the encoding of the whole. If
they don't pass, the region grows, each time by twice as many leaves. The result always equals a count of the edited text from
scratch.

Edge cases: a null text is empty and has no tokens. Very long texts have as many leaves as they need. Edits
beyond the text's ends are clipped. Repeated rows, and rows with equal or null ids, repeat. Empty tables
give empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codeloom.llm import bpe
from codeloom.llm.common import rows_of, tidied

LEAF = 256
#: A stretch without a safe cut is cut inside from this many characters on.
LONG = 4 * LEAF
#: White space of the pattern's engine.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = regex.compile(rf"(?<=[^{_S}])(?=[{_S}])|(?<=\p{{L}})(?=[^{_S}\p{{L}}])|(?<=\p{{N}})(?=[^{_S}\p{{N}}])|(?<=[^{_S}\p{{L}}\p{{N}}'])(?=[\p{{L}}\p{{N}}])")
#: Three characters of a run before a cut and one after it; contractions have two letters at most.
INSIDE = regex.compile(rf"\p{{L}}{{4}}|\p{{N}}{{4}}|[^{_S}'\p{{L}}\p{{N}}]{{4}}")


class Coder:
    """Token ids by a rank file, and how byte-pair encoding merges two tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.pieces = bpe.read_ranks(path)
        self.ranks = {p: k for k, p in enumerate(self.pieces)}
        self.encode = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, encoded as one piece, are these two tokens."""
        parts = [bytes([x]) for x in self.pieces[a] + self.pieces[b]]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(x + y, len(self.ranks)), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts == [self.pieces[a], self.pieces[b]]


class Leaf(tuple):
    """(text, tokens, inside): ``inside`` if the leaf begins within a pre-token."""


class TokenTree:
    """Leaves, and sums of characters and tokens above them."""

    def __init__(self, text: str, coder: Coder):
        self.coder, self.encoded = coder, 0
        self._build(self._leaves_of(text, False))

    def _build(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves or [Leaf(("", 0, False))]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (text, tokens, _) in enumerate(self.leaves):
            self.chars[self.base + k] = len(text)
            self.tokens[self.base + k] = tokens
        for k in range(self.base - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _encode(self, text: str) -> list[int]:
        self.encoded += len(text)
        return self.coder.encode(text)

    def _leaves_of(self, text: str, inside: bool) -> list[Leaf]:
        out, at = [], 0
        while at < len(text):
            cut = SAFE.search(text, at + LEAF)
            to = cut.start() if cut else len(text)
            part, ids = text[at:to], self._encode(text[at:to])
            last = tokens = 0
            for c, n in self._ends(part, ids) if len(part) > LONG else ():
                if c - last >= LEAF and INSIDE.fullmatch(part, c - 3, c + 1):
                    out.append(Leaf((part[last:c], n - tokens, inside)))
                    last, tokens, inside = c, n, True
            out.append(Leaf((part[last:], len(ids) - tokens, inside)))
            at, inside = to, False
        return out

    def _ends(self, part: str, ids: list[int]) -> list[tuple[int, int]]:
        """(characters, tokens) up to each end of a token that is the end of a character."""
        sizes = np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in part), np.int64, len(part))
        tokens = np.cumsum([len(self.coder.pieces[k]) for k in ids])
        _, c, n = np.intersect1d(np.cumsum(sizes), tokens, return_indices=True)
        return list(zip((c + 1).tolist(), (n + 1).tolist()))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(t for t, *_ in self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the characters before that leaf."""
        k, before = 1, 0
        while k < self.base:
            k *= 2
            if at - before >= self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.base, before

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with text on one side."""
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf][0]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end-1 by ``new``."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, last = self.find(max(0, start - 1))[0], self.find(end)[0]
        more = 1
        while True:
            for _ in range(more):
                left, right = self._beside(first, -1), self._beside(last, 1)
                first, last = first if left is None else left, last if right is None else right
            more *= 2
            before = self._chars_before(first)
            region = "".join(t for t, *_ in self.leaves[first : last + 1])
            parts = self._leaves_of(region[: start - before] + new + region[end - before :], self.leaves[first][2])
            left, right = self._beside(first, -1), self._beside(last, 1)
            if not parts and (left is not None or right is not None):
                continue
            if left is not None and parts[0][2] and not self._meet(self.leaves[left][0], parts[0][0]):
                continue
            if right is not None and self.leaves[right][2] and not self._meet(parts[-1][0], self.leaves[right][0]):
                continue
            break
        slots = last - first + 1
        if len(parts) > 4 * slots or not parts:
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :])
            return
        # As many slots as before: the tree keeps its shape and only the paths above change.
        per = -(-len(parts) // slots)
        for k in range(slots):
            own = parts[k * per : (k + 1) * per]
            leaf = Leaf(("".join(t for t, *_ in own), sum(n for _, n, _ in own), bool(own) and own[0][2]))
            self.leaves[first + k] = leaf
            self._change(first + k, len(leaf[0]), leaf[1])

    def _meet(self, left: str, right: str) -> bool:
        """Whether the last token of ``left`` and the first of ``right`` stay apart."""
        return self.coder.apart(self._encode(left)[-1], self._encode(right)[0])

    def _chars_before(self, leaf: int) -> int:
        k, total = self.base + leaf, 0
        while k > 1:
            if k % 2:
                total += self.chars[k - 1]
            k //= 2
        return total

    def _change(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.base + leaf
        by_chars, by_tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += by_chars
            self.tokens[k] += by_tokens
            k //= 2


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


Edit = tuple[int, int, str]


def middle_edit(text: str) -> list[Edit]:
    """The edits of the driver query: a phrase goes in at a third, a tenth is cut out at two thirds."""
    n = len(text)
    return [(2 * n // 3, 2 * n // 3 + n // 10, ""), (n // 3, n // 3, " an inserted phrase, twice")]


@tidied
def _counts(batches: Iterator[pa.RecordBatch], path: str, edits: Callable[[str], list[Edit]]) -> Iterator[pa.RecordBatch]:
    own = coder(path)
    names = ["doc_id", "n_chars", "n_leaves", "n_tokens", "edited_chars", "edited_tokens", "recoded_chars"]
    for b in rows_of(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tree = TokenTree(text or "", own)
            row = [doc_id, tree.n_chars, len(tree.leaves), tree.n_tokens]
            tree.encoded = 0
            for e in edits(text or ""):
                tree.edit(*e)
            rows.append((*row, tree.n_chars, tree.n_tokens, tree.encoded))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def counts(docs: DataFrame, path: str, edits: Callable[[str], list[Edit]] = middle_edit) -> DataFrame:
    """Per row: doc_id, n_chars, n_leaves, n_tokens, then of the edited text edited_chars,
    edited_tokens, and recoded_chars, the characters that the edits made it encode again."""
    schema = "doc_id long, n_chars long, n_leaves long, n_tokens long, edited_chars long, edited_tokens long, recoded_chars long"
    return docs.select("doc_id", "text").mapInArrow(partial(_counts, path=path, edits=edits), schema)
