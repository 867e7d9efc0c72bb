"""License scans by a generalised suffix automaton of license words.

The automaton holds all substrings of all templates (word by word; :mod:`codeloom.llm.license_texts`). A file streams through it and
each word gets its matching statistics: of each template, the length of its longest substring that
ends there, and where that lies (the longest of all, and up the suffix links those of templates that
lack it). Statistics that can't be extended further are long matches; of each template they are chained by weight in file order and template order, overlaps trimmed, into a
covered span, and the share of the template that the chain covers is its score. Base phrases are strings of the automaton as
well: a place of a phrase is a word at which the phrase is a suffix of the current match, which the
automaton's suffix links tell.

Words outside the templates' vocabulary reset the match, so most of a file costs one dictionary
lookup a word. The automaton is built from the templates on each Python worker; its size depends
on them alone.

Edge cases: a null text is empty and has no words, labels or places, and score 0. Very long texts
stream; memory is that of their words. Of spans of one template that overlap the best covered stays, of
equally covered ones the first. Repeated rows, and rows with equal or null ids, repeat. Empty tables give
empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.common import rows_of, tidied
from codeloom.llm.license_texts import TEMPLATES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: A match counts from this many words on (more in templates of ``LONG`` words, where pairs of common words lie in many
#: places), and a label from this covered share of a template on.
LEAST_MATCH, LEAST_LONG, LONG, LEAST_SHARE = 2, 4, 40, 0.8


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(LOWER) if not text.isascii() else text.lower())


class Automaton:
    """A generalised suffix automaton over lists of words.

    ``first_end`` has one template and position where a state's strings end.
    """

    def __init__(self, templates: list[list[str]], phrases: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first_end: list[tuple[int, int]] = [(-1, -1)]
        for t, ws in enumerate([*templates, *phrases]):
            last = 0
            for i, w in enumerate(ws):
                last = self._extend(last, w, (t, i))
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for t, ws in enumerate(templates):
            s = 0
            for i, w in enumerate(ws):
                s = self.next[s][w]
                self.ends[s].add((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.vocabulary = frozenset(self.next[0])
        # Of each state, for each template, its longest substring among the state's suffixes: (template, length, ends).
        self.profile: list[list[tuple[int, int, tuple[int, ...]]]] = []
        for s in range(len(self.next)):
            own: dict[int, tuple[int, tuple[int, ...]]] = {}
            up = s
            while up > 0 and self.length[up] >= LEAST_MATCH:
                for t in {t for t, _ in self.ends[up]} - own.keys():
                    own[t] = (self.length[up], tuple(sorted(e for x, e in self.ends[up] if x == t)))
                up = self.link[up]
            self.profile.append([(t, n, ends) for t, (n, ends) in own.items()])
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        found = []
        for p, ws in enumerate(phrases):
            s = 0
            for w in ws:
                s = self.next[s][w]
            found.append((s, p, len(ws)))
        for s in range(len(self.next)):
            up = s
            while up > 0:
                self.phrases[s] += [(p, n) for at, p, n in found if at == up]
                up = self.link[up]

    def _extend(self, last: int, w: str, end: tuple[int, int]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, {}, -1, end)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, following: dict, link: int, end: tuple[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.first_end.append(end)
        return len(self.next) - 1

    def _clone(self, p: int, w: str, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first_end[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def statistics(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of each word at which some substring of a template ends."""
        following, link, longest = self.next, self.link, self.length
        known = self.vocabulary.__contains__
        state = length = 0
        previous = -2
        for i in [i for i, k in enumerate(map(known, words)) if k]:
            if i != previous + 1:
                state = length = 0
            previous = i
            w = words[i]
            while w not in following[state]:
                state = link[state]
                length = longest[state]
            state, length = following[state][w], length + 1
            yield i, state, length


class Scanner:
    def __init__(self, templates: tuple = TEMPLATES, base: tuple = BASE):
        self.labels = [label for label, _ in templates]
        self.templates = [words_of(t) for _, t in templates]
        self.least = [LEAST_LONG if len(t) >= LONG else LEAST_MATCH for t in self.templates]
        self.base = [(words_of(p), label) for p, label in base]
        self.automaton = Automaton(self.templates, [p for p, _ in self.base])

    def scan(self, text: str) -> dict:
        """n_words; places (start, label) of base phrases; spans (label, start, end, share) of templates."""
        words = words_of(text)
        places: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        a, last, open_ = self.automaton, -2, {}

        def close(t: int, n: int, ends: tuple[int, ...]) -> None:
            if n >= self.least[t]:
                matches.setdefault(t, []).extend((last - n + 1, e - n + 1, n) for e in ends)

        for i, state, length in a.statistics(words):
            for p, n in a.phrases[state]:
                if n <= length:
                    places.append((i - n + 1, self.base[p][1]))
            own = {t: (min(length, n), ends) for t, n, ends in a.profile[state]} if length >= LEAST_MATCH else {}
            for t, (n, ends) in open_.items():
                if i != last + 1 or own.get(t, (0,))[0] != n + 1:
                    close(t, n, ends)
            open_, last = own, i
        for t, (n, ends) in open_.items():
            close(t, n, ends)
        return {"n_words": len(words), "places": sorted(places), "spans": self._spans(matches)}

    def _spans(self, by_template: dict[int, list[tuple[int, int, int]]]) -> list[tuple[str, int, int, float]]:
        """The heaviest chains of maximal matches that don't overlap, template by template.

        Words of a chain are different words of the template, from its first match's place on. So the template's words
        that the matches within reach cover, and those from that place on, bound its share, and only starts that
        may lead to a label or to the best share so far are chained.
        """
        out = []
        for t, found in sorted(by_template.items()):
            size, best = len(self.templates[t]), 0.0
            found.sort()
            # A chain goes on, in the file and the template, within half a template more.
            reach = size + size // 2 + 2
            chains, to, covered, times = [], 0, 0, [0] * size
            for k, (start, place, n) in enumerate(found):
                while to < len(found) and found[to][0] - start <= reach:
                    for x in range(found[to][1], found[to][1] + found[to][2]):
                        covered += not times[x]
                        times[x] += 1
                    to += 1
                bound = min(covered, size - place) / size
                if bound >= LEAST_SHARE or bound > best:
                    words, end = _heaviest(found[k:to])
                    share = min(1.0, words / size)
                    best = max(best, share)
                    chains.append((-share, start, end))
                for x in range(place, place + n):
                    times[x] -= 1
                    covered -= not times[x]
            taken: list[tuple[int, int]] = []  # in order, without overlaps
            for share, start, end in sorted(chains):
                at = bisect_left(taken, (start,))
                if (at == len(taken) or taken[at][0] >= end) and (not at or taken[at - 1][1] <= start):
                    taken.insert(at, (start, end))
                    out.append((self.labels[t], start, end, -share))
        return out


def _heaviest(found: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Words and end of the heaviest chain from the first of sorted matches (start, place in the template, length).

    A match that overlaps the one before, in the file or the template, counts from where that ends.
    """
    s, b, n = np.array(found, np.int64).T
    weight = np.zeros(len(found), np.int64)
    weight[0] = n[0]
    for j in range(1, len(found)):
        left = n[j] - np.maximum(0, np.maximum(s[:j] + n[:j] - s[j], b[:j] + n[:j] - b[j]))
        good = (weight[:j] > 0) & (left > 0) & (s[:j] < s[j]) & (b[:j] < b[j])
        weight[j] = np.where(good, weight[:j] + left, 0).max()
    top = int(weight.argmax())
    return int(weight[top]), found[top][0] + found[top][2]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


@tidied
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = scanner()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    for b in rows_of(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = s.scan(text or "")
            starts = [p for p, _ in found["places"]]
            base = {label for _, label in found["places"]}
            sure = [x for x in found["spans"] if x[3] >= LEAST_SHARE]
            score = max([1.0 if base else 0.0, *(x[3] for x in found["spans"])])
            row = (doc_id, found["n_words"], len(starts), min(starts, default=None), max(starts, default=None))
            spans = ",".join(f"{label}:{a}:{e}" for label, a, e, _ in sorted(set(sure), key=lambda x: (x[1], x[2], x[0])))
            rows.append((*row, ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in sure})), round(score, 6), spans))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)
