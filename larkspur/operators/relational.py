"""Relational operators beyond the DataFrame API: DISTINCT ON, WITH TIES, GROUPS frames, recursion, project sets, joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_dir


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order, which should break ties. Spark keeps one row a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def limit_with_ties(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The first n rows by order and all rows equal to the last of them in keys.

    A top-n finds the last row; only it is compared with the input, which stays distributed.
    """
    last = df.orderBy(*order).limit(n).select(*keys)
    return df.join(last.distinct(), [df[k].eqNullSafe(last[k]) for k in keys], "left_semi")


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, before: int, after: int, **aggregates: Callable[[], Column]) -> DataFrame:
    """Aggregates over a GROUPS frame: peers count as one step, so a dense rank takes the place of the order."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.col(order).asc_nulls_last())))
    w = Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after)
    return ranked.select("*", *[f().over(w).alias(k) for k, f in aggregates.items()]).drop("_g")


def project_set(df: DataFrame, **arrays: Column) -> DataFrame:
    """Set-returning columns side by side; shorter ones are filled with NULL, rows without elements vanish."""
    zipped = F.arrays_zip(*[a.alias(k) for k, a in arrays.items()])
    return df.select("*", F.explode(zipped).alias("_z")).select(*df.columns, *[F.col("_z").getField(k).alias(k) for k in arrays])


def recursive_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """WITH RECURSIVE … UNION: apply step to the new rows until none is new. Rows are compared as a whole, NULLs as equal.

    Each round is written to the folder of spark.checkpoint.dir, which cuts the lineage; only a count reaches the driver. The
    rounds seen are packed into one table whenever their number doubles the plan. most: rounds after which it is an error to
    go on; without it the recursion runs to its end.
    """
    shared_dir(seed.sparkSession)
    new = seed.distinct().checkpoint()
    seen, tables, rounds = new, 1, 0
    while True:
        if rounds == most:
            raise RuntimeError(f"the recursion did not end after {most} rounds")
        rounds += 1
        found = step(new).distinct()
        new = found.join(seen, [found[c].eqNullSafe(seen[c]) for c in seed.columns], "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen, tables = seen.union(new), tables + 1
        if tables == 8:
            seen, tables = seen.checkpoint(), 1


def materialized(df: DataFrame) -> DataFrame:
    """df computed once for all of its uses, in the folder of spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sample_by_key(df: DataFrame, key: str, share: float) -> DataFrame:
    """A share of the rows, to a thousandth, the same at each run: those whose key's multiple falls low. NULL keys are left out."""
    return df.where(F.pmod(F.col(key) * 7919, F.lit(1000)) < round(share * 1000))


def rollup_sets(*keys: str) -> list[tuple[str, ...]]:
    """The key sets of ROLLUP: all keys, then each time one less."""
    return [keys[:k] for k in range(len(keys), -1, -1)]


def crossed_sets(*lists: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The key sets of several grouping clauses side by side, each once, as GROUP BY DISTINCT has them."""
    out: dict[frozenset, tuple[str, ...]] = {}
    for chosen in product(*lists):
        keys = tuple(dict.fromkeys(k for s in chosen for k in s))
        out.setdefault(frozenset(keys), keys)
    return list(out.values())


def group_by_sets(df: DataFrame, sets: Sequence[tuple[str, ...]], *aggregates: Column) -> DataFrame:
    """Aggregates by each of some key sets; keys that a set lacks are NULL."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equal values in all columns of the same name, each once in the result."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """NOT IN with SQL's NULL rules: a NULL on the right empties the result, NULL keys on the left never pass unless the right is empty."""
    left, right = df.alias("l"), other.select(F.col(other_key).alias("_k")).alias("r")
    summary = right.agg(F.count("*").alias("_n"), F.sum(F.col("_k").isNull().cast("int")).alias("_nulls"))
    kept = left.join(right.where("_k IS NOT NULL"), F.col(f"l.{key}") == F.col("r._k"), "left_anti")
    return kept.join(F.broadcast(summary), F.lit(True)).where(f"_n = 0 OR (_nulls = 0 AND {key} IS NOT NULL)").drop("_n", "_nulls")  # one row


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, aggregate: Column) -> DataFrame:
    """A cross table; named values keep it to one job."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(aggregate)


#: Rows of a side in one block of block_join, over all keys, and tasks for each pair of blocks.
BLOCK_ROWS, BLOCK_TASKS = 1 << 15, 4


def block_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, residual: Column) -> DataFrame:
    """An inner join on a key of few values whose pairs are many: its work is the pairs, which a join by key alone gives few tasks.

    Rows are dealt to blocks by their hash, each row is sent to all blocks of the other side, and a key's pairs of two blocks
    are joined together. A task holds a block's rows of a key at most, and the tasks grow with the pairs; they are
    of a set number, as adaptive execution would pack them by their input.
    """
    a, b = (max(1, -(-side.count() // BLOCK_ROWS)) for side in (left, right))
    n = max(16, a * b * BLOCK_TASKS)

    def dealt(side: DataFrame, key: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        block = F.pmod(F.xxhash64(*side.columns), F.lit(own[1])).alias(own[0])
        spread = side.select("*", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other[1] - 1).cast("long"))).alias(other[0]))
        return spread.where(F.col(key).isNotNull()).repartition(n, key, *sorted((own[0], other[0])))

    x, y = dealt(left, left_key, ("_a", a), ("_b", b)), dealt(right, right_key, ("_b", b), ("_a", a))
    pairs = x.join(y, (x[left_key] == y[right_key]) & (x["_a"] == y["_a"]) & (x["_b"] == y["_b"]) & residual)
    return pairs.select(*[x[c] for c in left.columns], *[y[c] for c in right.columns])
