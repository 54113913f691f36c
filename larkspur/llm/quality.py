"""Quality rules: text statistics by Spark functions, and a learned decision list over them.

The list is learned by sequential covering: a rule grows threshold by threshold towards the highest gain on two thirds of
the labelled sample, is pruned from its end on the other third, and removes what it covers before the next one grows. The
rules become one ordered CASE expression, so scoring a corpus is a single scan without a shuffle and without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD_GAP = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Base limits: fewest words, and the percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Labelled rows that the learner sees, at most: those whose key hashes lowest.
TRAIN_ROWS = 20_000
#: Limits of the learner.
MOST_RULES, MOST_TERMS, THRESHOLDS, LEAST_PRECISION, LEAST_COVER = 12, 3, 48, 0.97, 5


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of size words that occur twice or more in the text."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, size)))

    def exact() -> Column:
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("k"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["k"] == F.get(s, j - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(s, j + 1)["k"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _bind(_bind(windows, places), covered)

    # equal windows have equal hashes: only texts with a repeated hash are compared word by word
    repeats = _bind(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= size, F.lit(0)).when(repeats, exact()).otherwise(F.lit(0)).cast("long")


def statistics(text: Column) -> Column:
    """A struct of the text's statistics. A null text has no words and no lines.

    It is one closed expression that reads the text once, wherever the optimizer moves it.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(without(x, SPACE_CHARS)) > 0)

    def count(b: Column) -> Column:
        n, solid, least = F.size(b["words"]), F.length(b["solid"]), F.greatest(F.size(b["words"]), F.lit(1))
        return F.struct(
            n.cast("long").alias("n_words"),
            solid.cast("long").alias("word_chars"),
            (solid - F.length(without(b["solid"], SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(b["words"]).alias("n_repeat_words"),
            F.size(b["lines"]).alias("n_lines"),
            ((solid - F.length(without(b["solid"], "!"))) / least).alias("bangs"),
            ((solid - F.length(without(b["solid"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / F.greatest(solid, F.lit(1))).alias("capitals"),
            (F.size(F.array_distinct(b["words"])) / least).alias("distinct"),
        )

    return _bind(F.struct(words.alias("words"), lines.alias("lines"), without(t, SPACE_CHARS).alias("solid")), count)


def features(s: Column) -> dict[str, Column]:
    """What rules are made of, from a struct of statistics."""
    words = F.greatest(s["n_words"], F.lit(1))
    return {
        "words": s["n_words"].cast("double"),
        "mean_word": s["word_chars"] / words,
        "symbols": s["n_symbols"] / words,
        "dup_lines": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeated": s["n_repeat_words"] / words,
        "bangs": s["bangs"],
        "capitals": s["capitals"],
        "distinct": s["distinct"],
    }


FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeated", "bangs", "capitals", "distinct")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MOST_REPEATED)


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.4g}"


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits won by a term on the positives that it keeps."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> list[Term]:
    rule: list[Term] = []
    while len(rule) < MOST_TERMS and y.any() and not y.all():
        best = (1e-9, None)
        for k, name in enumerate(names):
            at = x[:, k]
            for above in (True, False):
                hit = at[None, :] >= cuts[k][:, None] if above else at[None, :] <= cuts[k][:, None]
                p = (hit & y).sum(axis=1)
                gain = _gain(int(y.sum()), int((~y).sum()), p, hit.sum(axis=1) - p)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), Term(name, above, float(cuts[k][gain.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = best[1].covers(x, names)
        x, y = x[hit], y[hit]
    return rule


def covered(rule: list[Term], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for term in rule:
        out &= term.covers(x, names)
    return out


def learn_rules(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, names: list[str]) -> list[list[Term]]:
    """An ordered list of rules for bad rows; prune marks the rows that are held back from growing."""
    rules: list[list[Term]] = []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, THRESHOLDS))) if len(x) else np.zeros(0) for k in range(len(names))]
    # and the middle between the classes' own quantiles, which a rare class would not show in the whole
    for k in range(len(names)):
        if bad.any():
            cuts[k] = np.unique(np.r_[cuts[k], np.quantile(x[bad, k], np.linspace(0, 1, THRESHOLDS))])
    while len(rules) < MOST_RULES and len(x):
        rule = _grow(x[~prune], bad[~prune], names, cuts)
        hx, hb = x[prune], bad[prune]

        def worth(r: list[Term], hx=hx, hb=hb) -> float:
            hit = covered(r, hx, names)
            p, n = int((hit & hb).sum()), int((hit & ~hb).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covered(rule, hx, names) if rule else np.zeros(len(hx), dtype=bool)
        p, n = int((hit & hb).sum()), int((hit & ~hb).sum())
        if not rule or p + n < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
        rest = ~covered(rule, x, names)
        x, bad, prune = x[rest], bad[rest], prune[rest]
    return rules


def rejects(rules: list[list[Term]], s: Column) -> Column:
    """The list as an ordered conditional over statistics: the number of the first rule that rejects a row, 0 if none does."""
    have = features(s)
    out = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules, 1):
        hit = F.lit(True)
        for term in rule:
            hit &= have[term.feature] >= term.threshold if term.above else have[term.feature] <= term.threshold
        out = out.when(hit, k)
    return out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> list[list[Term]]:
    """Learn the rules from at most rows labelled rows; those that fail the base limits and null labels teach nothing.

    Repeated labels of a key teach as one, by their minimum, and repeated rows of a document by their least statistics. Values that
    tie at a threshold fall on one side of it together. Empty tables give no rules.
    """
    sample = (
        labels.where(F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias("_y"))
        .join(docs.select(key), key, "left_semi")
        .orderBy(F.xxhash64(key), key)
        .limit(rows)
    )
    # the sample has a fixed size, so it is sent to the documents
    seen = docs.select(key, text).join(F.broadcast(sample), key)
    got = (
        seen.select(F.xxhash64(key).alias("o"), (F.col("_y") == 0).alias("bad"), (F.xxhash64(F.col(key), F.lit(1)) % 3 == 0).alias("held"), _bind(statistics(F.col(text)), lambda s: F.struct(base_failed(s).alias("failed"), *[c.alias(k) for k, c in features(s).items()])).alias("s"))
        .groupBy("o", "bad", "held")  # a key that many rows have teaches once
        .agg(F.min("s").alias("s"))
        .orderBy("o")
        .collect()
    )
    got = [r for r in got if not r["s"]["failed"]]
    x = np.array([[r["s"][k] for k in FEATURES] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return learn_rules(x, np.array([r["bad"] for r in got], dtype=bool), np.array([r["held"] for r in got], dtype=bool), list(FEATURES))


def verdict(text: Column, rules: list[list[Term]]) -> Column:
    """A struct for a text: its statistics, base_failed, rule (the rejecting one, 0 for none) and kept.

    A null or empty text has no words and fails the base limits. It is an expression of the row, so repeated rows get equal
    verdicts and an empty table none; a text of any length is judged as a whole.
    """

    def judge(s: Column) -> Column:
        counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return _bind(F.struct(*[s[c].alias(c) for c in counts], base_failed(s).alias("base_failed"), rejects(rules, s).alias("rule")), lambda v: F.struct(*[v[c].alias(c) for c in (*counts, "base_failed", "rule")], (~v["base_failed"] & (v["rule"] == 0)).alias("kept")))

    return _bind(statistics(text), judge)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; a null or empty text has no words and fails the base limits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", verdict(F.col("text"), rules).alias("v")).select("doc_id", *[f"v.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
