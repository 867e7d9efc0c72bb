"""Personal data by patterns and by information-theoretic disclosure, in built-in functions only.

Base spans are the matches of four patterns that pass their checks. The method adds two kinds of spans.
Secrets are runs of ASCII letters and digits, with both, of at least ``LEAST_SECRET`` characters that carry
at least ``SECRET_BITS`` bits (entropy of the characters times length), such as keys and tokens. Terms are
words that give a protected entity away, found from the corpus. Protected are three levels: each matched
value, the domain of each email, and each kind (email, ip, card, phone, secret) as a whole.

A term is a letter run of at least ``LEAST_TERM`` letters outside matches (shorter ones, two-letter names
too, never are). For each term among the ``WINDOW`` terms and matches before or after a match, whatever
stands between, the distinct contexts in which entity and term meet, and the distinct texts with the pair,
with the term and with the entity, are counted over all documents. A term is disclosing if at least
``SUPPORT`` contexts hold the pair, the texts with the pair are at least ``GENERALISE`` of those with the
term (the entity's probability given the term), and the pointwise mutual information over texts is at
least ``BITS``. :func:`sanitise` replaces such terms by a placeholder, and removes those at ``REMOVE`` or
above. Copies of one passage are one context, so they don't make every rare word near an entity
disclosing; copies of a text are one text in every count, so they don't hide a term either.

Counting is by hash aggregation with partial sums, so a frequent entity or term is no hot group. Pairs are
cut early, by bounds that the definition implies: the information of an entity bounds that of its pairs,
and the texts with a term near any match, then those in a slice of the corpus, bound the texts with the
term from below. The disclosing terms are a checked, checkpointed table: up to ``LITERALS`` of them go
into the expressions of the scan, more are joined by the text's digest.

Patterns with repeated groups are possessive, and runs are only tried from their start or from the
end of the last match, so long runs take linear time and no stack.

Edge cases: a null text has no spans and stays null when sanitised. Very long texts are read whole; matches
and terms are sorted once, and each match looks at its neighbours only. Overlapping spans of several kinds
all count; in sanitised text they are covered once, under the first's placeholder. Repeated rows, and rows
with equal or null ids, repeat. Empty tables give empty results. :func:`detect` ignores extra columns;
:func:`sanitise` keeps all, of whatever name, and an ``n_chars`` column then has the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, let, prefix_sums, text_of

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, TERM_KIND = KINDS[:4], KINDS.index("term")
#: The base patterns; leftmost matches are those of the plain forms (possessive where nothing follows).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[0-9\x20-](?<=[0-9]|[0-9][\x20-](?=[0-9])))++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: What a match has, which is cheaper to look for; those of the other kinds have a digit (valid secrets too).
HINTS = {"email": "@", "phone": "+"}
TERM = r"\p{L}+"
#: Emails and secrets as wholes, else letter runs.
TOKEN = rf"{PATTERNS['email']}|{PATTERNS['secret']}|{TERM}"
LEAST_SECRET, SECRET_BITS = 16, 48.0
WINDOW, SUPPORT, GENERALISE, REMOVE, BITS, LEAST_TERM = 6, 3, 0.5, 0.8, 4.0, 3
LITERALS = 2_000
BROADCAST_ROWS = 100_000
#: One text of so many is in the slice that bounds counts from below.
SLICE = 32
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""

    def value(i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def information(x: Column) -> Column:
    """Bits of a string: the entropy of its characters times its length."""
    n = F.length(x)
    each = F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))

    def add(acc: Column, c: Column) -> Column:
        k = n - F.length(F.replace(x, c, F.lit("")))
        return acc + k * F.log2(n / k)

    return F.aggregate(each, F.lit(0.0), add)


def valid(kind: str, x: Column) -> Column:
    """The checks beside the pattern."""
    if kind == "ip":
        return F.forall(F.split(x, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(digits_of(x), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(x)).between(9, 15)
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (information(x) >= SECRET_BITS)
    return F.lit(True)


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Structs (start, end, value) of ``matches``, all matches of ``pattern`` in ``text``, in code points.

    A split at the same pattern has the stretches between, so lengths sum up to places.
    """

    def places(gaps: Column) -> Column:
        before = F.transform(F.slice(gaps, F.lit(1), F.size(matches)), lambda g: F.length(g))
        sizes = F.transform(matches, lambda m: F.length(m))
        sums = prefix_sums(F.zip_with(before, sizes, lambda a, b: a + b))

        def spans(s: Column, b: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(s, i) + F.get(b, i)
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

            return F.transform(matches, one)

        return let(before, lambda b: let(sums, lambda s: spans(s, b)))

    return let(F.split(text, pattern, -1), places)


def found(text: Column, kind: str) -> Column:
    """Valid matches of a kind as structs (start, end, value)."""
    pattern = PATTERNS[kind]
    shape = "array<struct<start:bigint,end:bigint,value:string>>"
    none = F.array().cast(shape)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = let(
        matches,
        lambda m: F.when(F.size(m) == 0, none).otherwise(
            F.filter(located(text, pattern, m), lambda x: valid(kind, x["value"])).cast(shape)
        ),
    )
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike("[0-9]")
    return F.when(hint, out).otherwise(none)


def base(text: Column, kinds: tuple[str, ...] = KINDS[:-1]) -> list[Column]:
    """A column of spans for each kind."""
    def spans(kind: str) -> Column:
        n = F.lit(KINDS.index(kind))
        return F.transform(found(text, kind), lambda x: F.struct(x["start"].alias("start"), n.alias("kind"), x["end"].alias("end"))).cast(SPANS)

    return [spans(k) for k in kinds]


def rendered(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(each, ",")


def _contexts(docs: DataFrame) -> DataFrame:
    """(entities, context, digest, words): a row for each distinct context of each value in each distinct text.

    ``entities`` are the hashes of the value, its kind and, of an email, its domain; ``words`` the distinct terms.
    """
    text = F.col("text")

    def item(kind: Column, x: Column, value: Column) -> Column:
        return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), value.alias("value"))

    shape = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
    tokens = F.filter(located(text, TOKEN, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), lambda w: (F.length(w["value"]) >= LEAST_TERM) & ~w["value"].rlike(r"\P{L}"))
    terms = F.transform(tokens, lambda w: item(F.lit(TERM_KIND), w, F.lower(w["value"]))).cast(shape)

    def of(kind: str) -> Column:
        return F.transform(found(text, kind), lambda x: item(F.lit(KINDS.index(kind)), x, x["value"])).cast(shape)

    matches = F.concat(*[of(k) for k in KINDS[:-1]])

    def around(items: Column) -> Column:
        def context(x: Column, i: Column) -> Column:
            near = F.concat(F.slice(items, F.greatest(F.lit(1), i - WINDOW + 1), F.least(i, F.lit(WINDOW))), F.slice(items, i + 2, F.lit(WINDOW)))
            words = F.transform(F.filter(near, lambda y: y["kind"] == TERM_KIND), lambda y: y["value"])
            return F.when(x["kind"] != TERM_KIND, F.struct(x["kind"].alias("kind"), x["value"].alias("value"), words.alias("words")))

        return F.array_compact(F.transform(items, context))

    none = F.array().cast("array<struct<kind:int,value:string,words:array<string>>>")
    # Terms are located once a text, and only in texts with matches.
    contexts = let(matches, lambda m: F.when(F.size(m) > 0, let(F.sort_array(F.concat(m, terms)), around)).otherwise(none))
    rows = docs.select(text_of().alias("text"))
    rows = rows.select(F.xxhash64("text").alias("digest"), F.explode(contexts).alias("c"))
    own = F.xxhash64("c.kind", "c.value")
    domain = F.when(F.col("c.kind") == 0, F.xxhash64(F.lit("domain"), F.lower(F.substring_index("c.value", "@", -1))))
    rows = rows.select(
        "digest", own.alias("value"), F.array_compact(F.array(own, F.xxhash64("c.kind"), domain)).alias("entities"),
        F.xxhash64("c.words").alias("context"), F.array_distinct("c.words").alias("words"),
    )
    # Copies of one text meet here first, before terms multiply the rows.
    rows = rows.groupBy("value", "context", "digest").agg(F.any_value("entities").alias("entities"), F.any_value("words").alias("words"))
    return rows.select("entities", "context", "digest", "words")


def _tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _among(docs: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """``docs`` with the distinct ones of its own letter runs that are in ``terms``, as array ``name``."""
    known = [r["term"] for r in terms.select("term").limit(LITERALS + 1).collect()]
    text = text_of()
    if len(known) <= LITERALS:
        if not known:
            return docs.withColumn(name, F.array().cast("array<string>"))
        return docs.withColumn(name, F.array_distinct(F.filter(_tokens(text), lambda w: w.isin(known))))
    keyed = docs.withColumn("__digest", F.sha2(text, 256))
    own = keyed.select("__digest", F.explode(F.array_distinct(_tokens(text))).alias("term"))
    hits = own.join(terms.select("term"), "term").groupBy("__digest").agg(F.collect_set("term").alias(name))
    joined = keyed.join(hits.withColumnRenamed("__digest", "__own"), F.col("__digest") == F.col("__own"), "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("__digest", "__own")


def _uses(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): in how many distinct texts each of ``terms`` occurs; those in none are left out."""
    digest = F.xxhash64(text_of()).alias("digest")
    n = terms.count()
    if n <= LITERALS:
        rows = _among(docs, terms, "__terms").select(digest, F.explode("__terms").alias("term"))
    else:
        right = terms.select("term")
        rows = docs.select(digest, F.explode(F.array_distinct(_tokens(text_of()))).alias("term"))
        rows = rows.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, "term")
    return rows.groupBy("term").agg(F.count_distinct("digest").alias("n_term"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(term, share, bits) of the disclosing terms, checkpointed."""
    docs = docs.select("text")
    digest = F.xxhash64(text_of())
    rows = cut(_contexts(docs))
    total = docs.select(digest.alias("digest")).distinct().count()
    entities = rows.select("digest", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count_distinct("digest").alias("n_entity"))
    # No pair has more information than its entity has.
    entities = entities.filter(F.log2(F.lit(float(total)) / F.col("n_entity")) >= BITS)
    words = rows.select("entities", "context", "digest", F.explode("words").alias("term"))
    pairs = words.select("context", "digest", "term", F.explode("entities").alias("entity"))
    pairs = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_pair"), F.count_distinct("digest").alias("n_texts"))
    pairs = pairs.filter(F.col("n_pair") >= SUPPORT).join(entities, "entity")
    # The texts with the term near any match are among those with the term, so this cuts only what the share cuts
    # in the end. A text counts once, however many matches stand around the term.
    around = words.groupBy("term").agg(F.count_distinct("digest").alias("n_around"))
    pairs = cut(pairs.join(around, "term").filter(F.col("n_texts") >= GENERALISE * F.col("n_around")))
    # So are the texts of a slice.
    part = docs.filter(F.pmod(digest, F.lit(SLICE)) == 0)
    seen = _uses(part, pairs.select("term").distinct()).withColumnRenamed("n_term", "n_part")
    pairs = cut(pairs.join(seen, "term", "left").filter(F.col("n_texts") >= GENERALISE * F.coalesce("n_part", F.lit(0))))
    uses = _uses(docs, pairs.select("term").distinct())
    scored = pairs.join(uses, "term").select(
        "term",
        (F.col("n_texts") / F.col("n_term")).alias("share"),
        F.log2(F.col("n_texts") * float(total) / (F.col("n_entity") * F.col("n_term"))).alias("bits"),
    )
    scored = scored.filter((F.col("share") >= GENERALISE) & (F.col("bits") >= BITS))
    return cut(scored.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")))


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the letter runs of ``text`` that are in the array ``terms``."""
    matches = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    spans = let(
        matches,
        lambda m: F.transform(
            F.filter(located(text, TERM, m), lambda x: F.array_contains(terms, F.lower(x["value"]))),
            lambda x: F.struct(x["start"].alias("start"), F.lit(TERM_KIND).alias("kind"), x["end"].alias("end")),
        ),
    )
    return F.when(F.size(terms) == 0, F.array().cast(SPANS)).otherwise(spans.cast(SPANS))


def detect(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term.

    ``terms``: the result of :func:`disclosing` where it is at hand.
    """
    terms = disclosing(docs) if terms is None else terms
    rows = _among(docs.select("doc_id", "text"), terms, "__terms")
    text = F.col("__text")
    rows = rows.select("doc_id", text_of().alias("__text"), "__terms")
    rows = rows.select("doc_id", *[c.alias(f"__{k}") for k, c in zip(KINDS, base(text))], _term_spans(text, F.col("__terms")).alias("__term"))
    rows = rows.withColumn("__base", F.sort_array(F.concat(*[F.col(f"__{k}") for k in BASE])))
    return rows.select(
        "doc_id",
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(rendered(F.col("__base")), 256).alias("base_sha256"),
        rendered(F.sort_array(F.concat("__base", "__secret", "__term"))).alias("spans"),
        F.size("__secret").cast("long").alias("n_secret"),
        F.size("__term").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with all spans replaced: matches and generalised terms by ``[kind]``, others removed."""
    terms = disclosing(docs) if terms is None else terms
    removed = terms.filter(F.col("share") >= REMOVE)
    # The row goes along as one value, so no helper's name can clash with a column's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    rows = _among(_among(rows, terms, "__terms"), removed, "__removed")
    text = text_of()
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def rewrite(spans: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start, end, at = x["start"].cast("int"), x["end"].cast("int"), acc["at"]
            between = F.substring(text, at + 1, F.greatest(F.lit(0), start - at))
            gone = (x["kind"] == TERM_KIND) & F.array_contains(F.col("__removed"), F.lower(F.substring(text, start + 1, end - start)))
            mark = F.when(start < at, "").when(gone, "").otherwise(F.get(names, x["kind"]))
            return F.struct(F.concat(acc["out"], between, mark).alias("out"), F.greatest(at, end).alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    spans = F.sort_array(F.concat(*base(text), _term_spans(text, F.col("__terms"))))
    new = F.when(F.col("text").isNull(), F.col("text")).otherwise(let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(rewrite(s))))
    rows = rows.select("__row", new.alias("__new"))
    made = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("__new").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[made.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])
