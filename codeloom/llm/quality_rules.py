"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a predicate that is true where a document must go. The verdict is their disjunction,
so it doesn't depend on their order; the cost does. On a sample, the rows with the smallest hashes over
all partitions, one job finds what each rule rejects and what the features that it looks at cost for the
sizes of each text, in units of work (``COSTS``). Rules are then taken by most rejections per cost among the
sampled rows that the rules before let pass, so overlapping rules don't count twice. Sample and costs
depend on the data alone: equal tables give equal orders.

Windows of three words are compared by 64-bit hashes, so counts of repeated words are exact but for
collisions (about one in 10**12 texts of a thousand words).

Edge cases: a null text counts as an empty one, which fails the base rule (no 50 words) and is
rejected. Very long texts are judged whole. Rows are judged one by one, so repeated rows and ids repeat, and
an empty table gives an empty result. Extra columns, of whatever name, are ignored by :func:`measure` and
kept by :func:`keep`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import let, text_of, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars`` (a character class): long runs of others go at once."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by 64-bit hashes. Sorted, equal ones are neighbours; most texts have
    few that repeat, and a look at each window finds where those stand. Where many repeat,
    sorting windows with their places keeps the time at n log n. The places merge into words.
    """
    zero = F.lit(0)

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return let(
            F.transform(
                places,
                lambda p, k: F.when(k == last, F.lit(3)).otherwise(F.least(F.lit(3), F.get(places, k + 1) - p)),
            ),
            lambda steps: F.aggregate(steps, zero, lambda a, x: a + x),
        )

    def by_sorting(h: Column) -> Column:
        def places(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
                return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"]))

        pairs = F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("p")))
        return let(F.sort_array(pairs), lambda s: let(places(s), covered))

    def by_looking(h: Column, repeated: Column) -> Column:
        places = F.filter(F.sequence(zero, F.size(h) - 1), lambda i: F.array_contains(repeated, F.get(h, i)))
        return let(places, covered)

    def judged(h: Column) -> Column:
        repeated = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
        return let(
            repeated,
            lambda r: F.when(F.size(r) == 0, zero).when(F.size(r) <= 12, by_looking(h, r)).otherwise(by_sorting(h)),
        )

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(zero, F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    return let(words, lambda w: F.when(F.size(w) < 3, zero).otherwise(let(windows(w), judged)))


class Features:
    """What rules look at, each a column that is evaluated only where a rule is reached.

    ``known`` has columns that are at hand already.
    """

    def __init__(self, text: Column, words: Column, **known: Column):
        self.text, self.words, self.known = text, words, known

    def __getattr__(self, name: str) -> Column:
        if name in self.known:
            return self.known[name]
        text, words = self.text, self.words
        return {
            "n_words": lambda: F.size(words),
            "word_chars": lambda: F.length(F.array_join(words, "")),
            "n_symbols": lambda: count_of(text, SYMBOLS),
            "n_exclamations": lambda: count_of(text, "!"),
            "n_capitals": lambda: count_of(text, "A-Z"),
            "n_lines": lambda: F.size(lines_of(text)),
            "n_dup_lines": lambda: n_dup_lines(text),
            "n_repeat_words": lambda: n_repeat_words(words),
            "n_distinct_words": lambda: F.size(F.array_distinct(words)),
        }[name]()


@dataclass(frozen=True)
class Rule:
    """``reject`` maps the features to a boolean column; ``base`` marks the rules of the contract."""

    name: str
    reject: Callable[[Features], Column]
    base: bool = False


RULES = (
    Rule("few_words", lambda f: f.n_words < 50, base=True),
    Rule("repeated_windows", lambda f: f.n_repeat_words * 100 > f.n_words * 50, base=True),
    Rule("symbols", lambda f: f.n_symbols * 10 > f.n_words * 3),
    Rule("capitals", lambda f: f.n_capitals * 10 > f.word_chars * 4),
    Rule("exclamations", lambda f: f.n_exclamations * 2 > f.n_words),
    Rule("repeated_lines", lambda f: f.n_dup_lines * 2 > f.n_lines),
    Rule("word_length", lambda f: (f.word_chars < f.n_words * 2) | (f.word_chars > f.n_words * 15)),
    Rule("vocabulary", lambda f: f.n_distinct_words * 20 < f.n_words),
)


#: Nanoseconds of a feature: per text, character, word, and word times the logarithm of the words (measured once on
#: 10,000 texts of 2,478 characters and 401 words on average, rounded; only their proportions matter).
COSTS = {
    "n_words": (20, 0, 0, 0),
    "word_chars": (200, 1, 0, 0),
    "n_symbols": (200, 4, 0, 0),
    "n_exclamations": (200, 4, 0, 0),
    "n_capitals": (200, 4, 0, 0),
    "n_lines": (200, 13, 0, 0),
    "n_dup_lines": (200, 13, 0, 0),
    "n_repeat_words": (500, 0, 600, 18),
    "n_distinct_words": (200, 0, 80, 0),
}


@dataclass(frozen=True)
class Estimate:
    """For each row of the sample, the cost of a rule and whether it rejects."""

    rule: Rule
    costs: list[float]
    rejects: list[bool]


class _Seen:
    """Notes the names of the features that a rule looks at."""

    def __init__(self):
        self.names: set[str] = set()

    def __getattr__(self, name: str) -> Column:
        self.names.add(name)
        return F.lit(1)


def features_of(rule: Rule) -> set[str]:
    seen = _Seen()
    rule.reject(seen)
    return seen.names


def cost(names: set[str], chars: int, words: int) -> float:
    """Of features for a text of so many characters and words."""
    size = (1, chars, words, words * math.log2(words + 1))
    return sum(a * b for n in names for a, b in zip(COSTS[n], size))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), rows: int = 200, longest: int = 100_000) -> list[Estimate]:
    """Costs and rejections on at most ``rows`` texts of at most ``longest`` characters.

    Features in ``known`` are at hand and cost nothing. The sample only orders the rules; no verdict depends on it.
    """
    # Hashes below a share of their range that holds about four times as many rows; so only these leave their tasks.
    least = -(1 << 63) + min((1 << 64) - 1, (rows * 4 << 64) // max(1, docs.count()))
    texts = docs.select(text_of().alias("text"), F.xxhash64("doc_id", "text").alias("at"))
    sample = texts.filter((F.col("at") <= least) & (F.length("text") <= longest)).orderBy("at", "text").limit(rows)
    names = [f"r{k}" for k in range(len(rules))]

    def look(words: Column) -> Column:
        f = Features(F.col("text"), words)
        return F.struct(F.length("text").alias("chars"), F.size(words).alias("words"), *[r.reject(f).alias(n) for r, n in zip(rules, names)])

    found = [r["x"] for r in sample.select(let(words_of(F.col("text")), look).alias("x")).collect()]
    return [Estimate(r, [1.0 + cost(features_of(r) - set(known), x["chars"], x["words"]) for x in found], [bool(x[n]) for x in found]) for r, n in zip(rules, names)]


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Most rejections per cost first, among the rows that the rules before let pass; ties by cost, then name."""
    left, out = list(estimates), []
    rows = set(range(len(estimates[0].costs))) if estimates else set()

    def merit(e: Estimate) -> tuple:
        spent = sum(e.costs[i] for i in rows)
        return (-sum(e.rejects[i] for i in rows) / spent if rows else 0.0, sum(e.costs), e.rule.name)

    while left:
        best = min(left, key=merit)
        left.remove(best)
        out.append(best.rule)
        rows = {i for i in rows if not best.rejects[i]}
    return out


def expected_cost(order: tuple[Estimate, ...] | list[Estimate]) -> float:
    """Of a row of the sample, run through the rules in ``order`` up to the first that rejects."""
    n, total = len(order[0].costs), 0.0
    for i in range(n):
        for e in order:
            total += e.costs[i]
            if e.rejects[i]:
                break
    return total / max(1, n)


def rejected(f: Features, rules: list[Rule]) -> Column:
    """True at the first rule that rejects; the later ones are then not evaluated."""
    out = F.lit(False)
    for r in reversed(rules):
        out = F.when(r.reject(f), F.lit(True)).otherwise(out)
    return out


def judged(text: Column, rules: list[Rule]) -> Column:
    """:func:`rejected` of a text, its words split once."""
    return let(words_of(text), lambda w: rejected(Features(text, w), rules))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the base measures, base_failed and kept. One scan, no shuffle."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = ordered(estimate(docs, tuple(r for r in rules if not r.base), known=names))
    text, words = F.col("__text"), F.col("__words")
    f = Features(text, words)
    out = (
        docs.select("doc_id", text_of().alias("__text"))
        .withColumn("__words", words_of(text))
        .select("doc_id", "__text", "__words", *[getattr(f, n).cast("long").alias(n) for n in names])
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    )
    known = Features(text, words, **{n: F.col(n) for n in names})
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected(known, own))
    return out.withColumn("kept", kept).drop("__text", "__words")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns; one scan, no shuffle."""
    return docs.filter(~judged(text_of(), ordered(estimate(docs, rules))))
