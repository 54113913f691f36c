"""Column statistics: null fractions, widths, distinct counts, common values, histograms, dependencies, sketches."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import percentiles


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column from one pass: rows, null fraction, mean width of its text, distinct values."""
    aggregates = [F.count("*").alias("rows")]
    for c in columns:
        aggregates += [(1 - F.count(c) / F.count("*")).alias(f"{c}|nulls"), F.avg(F.length(F.col(c).cast("string"))).alias(f"{c}|width"), F.countDistinct(c).alias(f"{c}|distinct")]
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.round(F.col(f"`{c}|nulls`"), 6).alias("null_fraction"), F.round(F.col(f"`{c}|width`"), 6).alias("avg_width"), F.col(f"`{c}|distinct`").alias("n_distinct")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def common_values(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The most common values, how often they occur, and their share of all rows; ties go to the smaller value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    rows = df.agg(F.count("*").alias("rows"))
    top = counts.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(most)
    return top.join(F.broadcast(rows)).select("value", "n", (F.col("n") / F.col("rows")).alias("frequency"))  # one row


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bound, value): the bounds of an equi-depth histogram, exact: the values at even shares of the sorted column."""
    shares = {str(k): (k / buckets, True) for k in range(buckets + 1)}
    one = percentiles(df, [], column, shares)
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("bound"), F.col(str(k)).alias("value")) for k in range(buckets + 1)])).alias("b")).select("b.*")


def estimate_distinct(sample: DataFrame, column: str, total_rows: Column) -> DataFrame:
    """Distinct values of a table from a sample of it: (d + f1 n / (n - f1)) N / n, f1 being the values seen once."""
    counts = sample.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    s = counts.agg(F.count("*").alias("d"), F.sum((F.col("c") == 1).cast("long")).alias("f1"), F.sum("c").alias("n"))
    extra = F.when((F.col("f1") > 0) & (F.col("n") > F.col("f1")), F.col("f1") * F.col("n") / (F.col("n") - F.col("f1"))).otherwise(0.0)
    return s.select("d", "f1", "n", ((F.col("d") + extra) * total_rows / F.col("n")).alias("estimate"))


def joint_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of every two or more columns: a pass for each, over its columns, which combines before the shuffle."""
    out = None
    for size in range(2, len(columns) + 1):
        for chosen in combinations(columns, size):
            one = df.select(*chosen).distinct().agg(F.lit("+".join(chosen)).alias("columns"), F.count("*").alias("n"))
            out = one if out is None else out.union(one)
    return out


def dependencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, degree) of all ordered pairs: one less the values of b beyond the first of each value of a, by rows."""
    out = None
    for a, b in permutations(columns, 2):
        pairs = df.groupBy(a, b).agg(F.count("*").alias("_n"))
        by = pairs.groupBy(a).agg(F.count(b).alias("_k"), F.sum("_n").alias("_n"))
        one = by.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), (1 - F.sum(F.greatest(F.col("_k") - 1, F.lit(0))) / F.sum("_n")).alias("degree"))
        out = one if out is None else out.union(one)
    return out


def approx_distinct(column: str, error: float = 0.0081) -> Column:
    return F.approx_count_distinct(column, error)


def distinct_counts(df: DataFrame, column: str, error: float = 0.0081) -> DataFrame:
    """(approximate, exact): the sketch's count of distinct values and the exact one, NULLs left out.

    Both are taken of the distinct values: a sketch is the same for repeated values, and beside a distinct aggregate of the
    whole table there would be a sketch for each value.
    """
    values = df.select(column).distinct()
    return values.agg(approx_distinct(column, error).alias("approximate"), F.count(column).alias("exact"))


def sketches(df: DataFrame, keys: Sequence[str], column: str, log_buckets: int = 14) -> DataFrame:
    """A mergeable distinct-count sketch (HyperLogLog) of each group, as bytes in column sketch."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, log_buckets).alias("sketch"))


def merged_sketches(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of larger groups from those of smaller ones."""
    return parts.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(parts: DataFrame) -> DataFrame:
    """The distinct count that each sketch estimates, as n."""
    return parts.withColumn("n", F.hll_sketch_estimate("sketch")).drop("sketch")


#: Bits of a Bloom filter, which bound what is sent to all tasks, and bits that a value sets.
BLOOM_BITS, BLOOM_HASHES = 1 << 20, 5


def _bits(value: Column, bits: int, hashes: int) -> Column:
    """The places of a value's bits; values are hashed as text, so that equal numbers of different types agree."""
    return F.array(*[F.pmod(F.xxhash64(value.cast("string"), F.lit(k)), F.lit(bits)) for k in range(hashes)])


def bloom_filter(df: DataFrame, column: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """A Bloom filter of a column's values, NULLs left out: one row, an array of bits / 64 words.

    Tasks combine words before the shuffle, which so has at most bits / 64 rows of each; the row is of fixed size.
    """
    places = df.where(F.col(column).isNotNull()).select(F.explode(_bits(F.col(column), bits, hashes)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    return found.select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bits // 64 - 1).cast("long")), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))).alias("bloom"))


def might_contain(df: DataFrame, column: str, bloom: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """The rows whose value may be in the filter: all that are, and few others. NULL never is."""
    words, found = bloom.scalar(), F.col(column).isNotNull()
    for k in range(hashes):
        p = F.get(_bits(F.col(column), bits, hashes), F.lit(k))
        found &= F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.where(found)
