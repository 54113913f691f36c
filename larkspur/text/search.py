"""Search vectors, queries, matching, ranking and headlines as column expressions.

A search vector is an array of (lexeme, positions) structs in order of lexeme. Queries are parsed on the driver and compiled
to expressions, so matching runs in the JVM, on the words that a query names. Whole vectors need Python, which gets texts in
Arrow batches and answers in small ones. Nothing here shuffles a text: a document's vector is made of its row alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import porter

WORD = "[a-z0-9_]+"
# fixed values: the English stop words
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that "
    "the their then there these they this to was will with i you he she we his her its"
).split()
# fixed values: plain suffixes and what takes their place
SUFFIXES = (("ies", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ing", ""), ("ly", ""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, in order; positions count from 1."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1))


VECTOR = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


#: Bytes of texts whose vectors a worker holds at once (a longer text is alone), and the longest word that it keeps.
PART_BYTES, LONGEST = 2 << 20, 64
WORD_BYTES = re.compile(WORD.encode())


@lru_cache(maxsize=200_000)
def lexeme_of(word: str, config: str) -> str | None:
    """A word's lexeme: english has none for stop words and stems the others, simple strips a plain suffix."""
    if config == "english":
        return None if word in STOP_WORDS else porter(word)
    for suffix, put in SUFFIXES:
        if word.endswith(suffix) and len(word) > len(suffix):
            return word[: -len(suffix)] + put
    return word


def vectors(texts: Sequence[bytes | None], config: str) -> pa.Array:
    """The search vectors of texts in UTF-8, as flat arrays: a document's words are objects only while it is read."""
    ends, lexemes, place_ends, places = array("i", [0]), [], array("i", [0]), array("i")
    for text in texts:
        by_word: dict[bytes, list[int]] = {}
        for k, word in enumerate(WORD_BYTES.findall((text or b"").lower()), 1):  # bytes: only ASCII letters change
            if word in by_word:
                by_word[word].append(k)
            else:
                by_word[word] = [k]
        found: dict[str, list[int]] = {}
        for word, at in by_word.items():
            lexeme = (lexeme_of if len(word) <= LONGEST else lexeme_of.__wrapped__)(word.decode(), config)
            if lexeme is not None:
                found[lexeme] = sorted(found[lexeme] + at) if lexeme in found else at
        for lexeme in sorted(found):
            lexemes.append(lexeme)
            places.extend(found[lexeme])
            place_ends.append(len(places))
        ends.append(len(lexemes))
    flat = lambda of: pa.Array.from_buffers(pa.int32(), len(of), [None, pa.py_buffer(of)])
    positions = pa.ListArray.from_arrays(flat(place_ends), flat(places))
    return pa.ListArray.from_arrays(flat(ends), pa.StructArray.from_arrays([pa.array(lexemes, pa.string()), positions], ["lexeme", "positions"]))


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of parts of at most PART_BYTES, or of one longer text."""
    first, part, held = 0, [], 0
    for k, text in enumerate(texts):
        value = text.as_buffer()
        size = len(value) if value is not None else 0
        if part and held + size > PART_BYTES:
            yield first, part
            first, part, held = k, [], 0
        part.append(value.to_pybytes() if value is not None else None)
        held += size
    if part:
        yield first, part


def _vectors(docs: DataFrame, keys: Sequence[str], text: str, config: str) -> DataFrame:
    """The keys and vector of every document, empty without lexemes."""
    plain = docs.select(*keys, F.col(text).cast("binary").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _parts(batch.column(len(keys))):
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], vectors(part, config)], batch.schema.names)

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[:-1], T.StructField("vector", VECTOR)]))


def term_vector(text: Column, terms: Sequence[str]) -> Column:
    """The search vector of a text with the words themselves as lexemes, of these words only: an expression of the row."""

    def of_tokens(t: Column) -> Column:
        places = lambda x: F.filter(F.transform(t, lambda y, k: F.when(y == x, k + 1)), lambda p: p.isNotNull())
        every = F.array(*[F.struct(F.lit(x).alias("lexeme"), places(F.lit(x)).alias("positions")) for x in sorted(terms)])
        return F.filter(every, lambda e: F.size(e["positions"]) > 0)

    return F.get(F.transform(F.array(tokens(text)), of_tokens), F.lit(0))


def simple_lexeme(word: Column) -> Column:
    """A word without its first matching plain suffix."""
    out = F.when(F.lit(False), word)
    for suffix, put in SUFFIXES:
        out = out.when(word.endswith(suffix) & (F.length(word) > len(suffix)), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put)))
    return out.otherwise(word)


def lexemes(docs: DataFrame, key: str, text: str, config: str = "english") -> DataFrame:
    """(key, lexeme, position) of every lexeme."""
    entries = to_tsvector(docs, key, text, config).select(key, F.explode("vector").alias("e"))
    return entries.select(key, "e.lexeme", F.explode("e.positions").alias("position"))


def to_tsvector(docs: DataFrame, key: str, text: str, config: str = "english") -> DataFrame:
    """(key, vector) of every document that has a lexeme: english stems words that are no stop words, simple strips a plain suffix."""
    return _vectors(docs, [key], text, config).where(F.size("vector") > 0)


def whole_words(words: Sequence[str]) -> str:
    """A pattern for occurrences of words as tokens finds them, in ASCII letters of either case."""
    return f"(?i)(?<![a-z0-9_])(?:{'|'.join(sorted(words))})(?![a-z0-9_])"


class Query:
    """A search query: & | ! and parentheses over lexemes."""

    def __init__(self, op: str, *parts):
        self.op, self.parts = op, parts

    @classmethod
    def parse(cls, text: str) -> Query:
        """The query that a literal stands for."""
        marks = re.findall(r"[&|!()]|[A-Za-z0-9_]+", text)
        if re.sub(r"[&|!()\sA-Za-z0-9_]", "", text):
            raise ValueError(f"no query: {text}")
        at = 0

        def take(mark: str) -> bool:
            nonlocal at
            if at < len(marks) and marks[at] == mark:
                at += 1
                return True
            return False

        def some() -> Query:
            left = every()
            while take("|"):
                left = cls("|", left, every())
            return left

        def every() -> Query:
            left = one()
            while take("&"):
                left = cls("&", left, one())
            return left

        def one() -> Query:
            nonlocal at
            if take("!"):
                return cls("!", one())
            if take("("):
                inner = some()
                if not take(")"):
                    raise ValueError("a parenthesis is open")
                return inner
            if at >= len(marks) or marks[at] in "&|!)":
                raise ValueError(f"a lexeme is missing in: {text}")
            at += 1
            return cls("word", marks[at - 1].lower())

        out = some()
        if at < len(marks):
            raise ValueError(f"too much in: {text}")
        return out

    @classmethod
    def of_text(cls, text: str, config: str = "english") -> Query | None:
        """All lexemes of a text; None if it has none."""
        words = [w for w in re.findall(WORD, text.lower()) if config != "english" or w not in STOP_WORDS]
        out = None
        for w in words:
            leaf = cls("word", porter(w) if config == "english" else w)
            out = leaf if out is None else cls("&", out, leaf)
        return out

    def terms(self) -> set[str]:
        return {self.parts[0]} if self.op == "word" else set().union(*(p.terms() for p in self.parts))

    def rewrite(self, rules: Mapping[str, Query]) -> Query:
        """Lexemes replaced by queries."""
        if self.op == "word":
            return rules.get(self.parts[0], self)
        return Query(self.op, *(p.rewrite(rules) for p in self.parts))

    def matches_text(self, text: Column) -> Column:
        """The boolean tree over the words of a text, each searched for up to its first occurrence."""
        if self.op == "word":
            return text.rlike(whole_words([self.parts[0]]))
        parts = [p.matches_text(text) for p in self.parts]
        return ~parts[0] if self.op == "!" else parts[0] & parts[1] if self.op == "&" else parts[0] | parts[1]

    def matches(self, vector: Column) -> Column:
        """The boolean tree over the lexemes of a vector."""
        if self.op == "word":
            return F.exists(vector, lambda e: e["lexeme"] == self.parts[0])
        parts = [p.matches(vector) for p in self.parts]
        return ~parts[0] if self.op == "!" else parts[0] & parts[1] if self.op == "&" else parts[0] | parts[1]


def _positions(vector: Column, query: Query) -> Column:
    words = list(query.terms())
    return F.array_sort(F.flatten(F.transform(F.filter(vector, lambda e: e["lexeme"].isin(words)), lambda e: e["positions"])))


def ts_rank(vector: Column, query: Query) -> Column:
    """Occurrences of the query's lexemes, each of weight 1."""
    return F.size(_positions(vector, query)).cast("double")


def text_rank(text: Column, query: Query) -> Column:
    """ts_rank of a text whose words are its lexemes, without its vector."""
    return F.regexp_count(text, F.lit(whole_words(sorted(query.terms())))).cast("double")


def ts_rank_cd(vector: Column, query: Query) -> Column:
    """Occurrences over one more than their mean gap, which is 1 for a single one."""
    at = _positions(vector, query)
    n = F.size(at)
    gap = F.when(n > 1, (F.element_at(at, -1) - F.element_at(at, 1)) / (n - 1)).otherwise(1.0)
    return F.when(n > 0, n / (1 + gap)).otherwise(0.0)


def text_rank_cd(text: Column, query: Query) -> Column:
    """ts_rank_cd of a text whose words are its lexemes, without its vector: the words between the first term and the last are counted."""
    term = whole_words(sorted(query.terms()))
    words = F.regexp_count(F.regexp_extract(text, f"(?s){term}(.*){term}", 1), F.lit("[A-Za-z0-9_]++")) + 1

    def of_count(n: Column) -> Column:
        return F.when(n > 1, n / (1 + words / (n - 1))).when(n > 0, n / 2.0).otherwise(0.0)

    return F.get(F.transform(F.array(F.regexp_count(text, F.lit(term))), of_count), F.lit(0))


def ts_headline(text: Column, query: Query, most_words: int = 35, start: str = "<b>", stop: str = "</b>") -> Column:
    """At most most_words words around the first word that is a term of the query, with terms marked.

    Only what lies before that word is read, up to it, and as much behind it as is shown.
    """
    words, span = sorted(query.terms()), "(?:[A-Za-z0-9_]++|[^A-Za-z0-9_]++)"
    is_term = lambda s: F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").isin(words)

    def around(left: Column) -> Column:
        before = F.reverse(F.regexp_extract(F.reverse(left), f"^{span}{{0,{most_words // 2}}}", 0))
        behind = F.regexp_extract(F.substring(text, F.length(left) + 1, F.length(text)), f"^{span}{{0,{2 * most_words}}}", 0)
        return F.regexp_extract_all(F.concat(before, behind), F.lit(f"({span})"), F.lit(1))

    def marked(spans: Column) -> Column:
        count = F.when(F.get(spans, F.lit(0)).rlike("^[A-Za-z0-9_]"), 2 * most_words - 1).otherwise(2 * most_words)
        return F.array_join(F.transform(F.slice(spans, 1, count), lambda s: F.when(is_term(s), F.concat(F.lit(start), s, F.lit(stop))).otherwise(s)), "")

    left = F.regexp_extract(text, f"(?s)^(.*?)(?={whole_words(words)})", 1)  # empty without a term, too
    spans = F.get(F.transform(F.array(left), around), F.lit(0))
    return F.get(F.transform(F.array(spans), marked), F.lit(0))


def lexeme_statistics(docs: DataFrame, key: str, text: str, most: int = 10, config: str = "english") -> DataFrame:
    """The most common lexemes by the number of documents that hold them, and the mean number of lexemes of a document."""
    if config == "english":
        found = _vectors(docs, [], text, config).select(F.explode("vector").alias("e")).select("e.lexeme")
    else:
        found = docs.select(F.explode(F.array_distinct(F.transform(tokens(F.col(text)), simple_lexeme))).alias("lexeme"))
    counts = found.groupBy("lexeme").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "lexeme").limit(most)
    mean = counts.agg(F.sum("n").alias("_n")).join(F.broadcast(docs.agg(F.count("*").alias("_docs"))))  # one row each
    return top.join(F.broadcast(mean.select(F.try_divide("_n", "_docs").alias("average_length"))))


def thesaurus_lexemes(word: Column, groups: Sequence[Sequence[str]]) -> Column:
    """All words of the first group of synonyms that has the word, which is compared in lower case; else the word alone."""
    lower = F.lower(word)
    first: dict[str, Sequence[str]] = {}
    for group in groups:
        for w in group:
            first.setdefault(w.lower(), [x.lower() for x in group])
    if not first:
        return F.array(lower)
    entries = F.create_map(*[x for w, group in first.items() for x in (F.lit(w), F.array(*map(F.lit, group)))])
    return F.when(word.isNotNull(), F.coalesce(entries[lower], F.array(lower)))


def affix_lexeme(word: Column, known: Sequence[str], affixes: Sequence[tuple[str, bool]]) -> Column:
    """The known word that is left when the first fitting affix (its letters, whether it is a prefix) goes, else the word in lower case."""
    lower, words = F.lower(word), [w.lower() for w in known]
    out = F.when(word.isNull(), None)
    for affix, prefix in affixes:
        affix = affix.lower()
        fits = lower.startswith(affix) if prefix else lower.endswith(affix)
        stem = F.substring(lower, F.lit(len(affix) + 1), F.length(lower)) if prefix else F.substring(lower, F.lit(1), F.length(lower) - len(affix))
        out = out.when(fits & (F.length(lower) > len(affix)) & stem.isin(words), stem)
    return out.otherwise(lower)
