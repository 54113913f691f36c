"""Running totals, ranks, sliding frames and percentiles without a task that holds a whole partition key.

A window over few keys sorts the table in as many tasks as there are keys. Here the order is cut into ranges at some of its
values, each range of each key is a task's work, and the sums of the earlier ranges are added from a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which an order is cut.
RANGES = 64
#: Types that have approximate percentiles.
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")
#: Rows of a key that are windowed together by sliding_rows.
RUN = 1 << 16


def range_number(df: DataFrame, order: str, ranges: int = RANGES) -> Column:
    """The number of the range of order that a row lies in; NULLs lie behind all.

    The bounds are at most ranges values near its quantiles, which are all that the driver gets. Equal values share a
    range, so a result does not depend on where the bounds lie.
    """
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    kind = df.select(F.col(order)).schema[0].dataType
    numeric = kind.typeName() in NUMERIC
    source = df.select(F.col(order).alias("v")).where("v IS NOT NULL")
    if numeric:
        found = source.agg(F.percentile_approx("v", shares, F.lit(1000)).alias("b"))
        bounds = sorted(set(found.first()["b"] or ()))
    else:  # values without a distance: those whose hashes are lowest stand for all
        bounds = sorted({r["v"] for r in source.distinct().orderBy(F.xxhash64("v")).limit(ranges - 1).collect()})
    value = F.col(order)
    n = F.lit(0)
    for k, b in enumerate(bounds, 1):
        n = F.when(value >= F.lit(b).cast(kind), k).otherwise(n)
    return F.when(value.isNull(), len(bounds) + 1).otherwise(n)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], **values: Column) -> DataFrame:
    """df with the sums of values over all rows of its key up to and with a row, in order, which should have no ties.

    A NULL adds nothing; a sum over NULLs alone is 0.
    """
    numbered = df.withColumn("_range", range_number(df, order[0])).select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    same = numbered["_range"] == totals["_r"]
    for k in keys:
        same &= numbered[k].eqNullSafe(totals[f"_k_{k}"])
    own = Window.partitionBy(*keys, "_range").orderBy(*[F.col(o).asc_nulls_last() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    placed = numbered.join(totals, same)
    return placed.select(*df.columns, *[(F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)) + F.col(f"_b_{k}")).alias(k) for k in values])


def ranks(df: DataFrame, keys: Sequence[str], order: str, rank: str = "rank", dense: str = "dense_rank") -> DataFrame:
    """df with rank and dense rank by order within keys: from the counts of the values, which are joined back."""
    counts = df.groupBy(*keys, order).agg(F.count("*").alias("_n"))
    placed = running_total(counts, keys, [order], _up=F.col("_n"), _dense=F.lit(1))
    placed = placed.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, order)], (F.col("_up") - F.col("_n") + 1).cast("long").alias(rank), F.col("_dense").cast("long").alias(dense))
    same = F.lit(True)
    for c in (*keys, order):
        same &= df[c].eqNullSafe(placed[f"_k_{c}"])
    return df.join(placed, same).select(*df.columns, rank, dense)


def sliding_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, **aggregates: Column) -> DataFrame:
    """df with aggregates over a frame of ROWS between before preceding and after following, by key.

    Rows are numbered by running totals and dealt to runs of RUN rows; a run also gets the rows around it that its
    frames reach, which are left out of the result.
    """
    numbered = running_total(df, keys, order, _row=F.lit(1)).withColumn("_run", F.floor((F.col("_row") - 1) / RUN))
    place = F.col("_row") - 1 - F.col("_run") * RUN
    runs = F.array(F.col("_run"), F.when(place < after, F.col("_run") - 1), F.when(place >= RUN - before, F.col("_run") + 1))
    spread = numbered.withColumn("_home", F.col("_run")).withColumn("_run", F.explode(F.filter(runs, lambda r: r.isNotNull() & (r >= 0))))
    w = Window.partitionBy(*keys, "_run").orderBy("_row").rowsBetween(-before, after)
    return spread.select("*", *[a.over(w).alias(k) for k, a in aggregates.items()]).where("_run = _home").select(*df.columns, *aggregates)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, tuple[float, bool]]) -> DataFrame:
    """A row for each key with the exact percentiles of value, named as in shares: (share, whether between values).

    Equal values are counted before anything is moved. Their counts by range say which ranges of a key hold a share's
    place; only these are sorted, each on its own. So no task sees more than a small part of a key's values, and no row is
    joined by key alone. NULLs don't count; a key of NULLs alone has NULL. A discrete percentile is the first value at or
    above its share of the rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    counts = counts.withColumn("_range", range_number(df, value))
    places = []
    for share, between in shares.values():
        place = F.lit(share) * (F.col("_all") - 1)
        places.append((F.floor(place), F.ceil(place)) if between else (F.greatest(F.ceil(F.lit(share) * F.col("_all")) - 1, F.lit(0)),))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_t").over(before), F.lit(0)), "_all": F.sum("_t").over(by_key)})
    holds = F.col("_all") == 0
    for place in [p for ps in places for p in ps]:
        holds |= (place >= F.col("_before")) & (place < F.col("_before") + F.col("_t"))
    chosen = totals.where(holds).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), "_before", "_all")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(chosen, same).withColumn("_up", F.sum("_n").over(own) + F.col("_before"))
    low, out = F.col("_up") - F.col("_n"), []
    at = lambda place: F.max(F.when((place >= low) & (place < F.col("_up")), F.col(value)))
    for (name, (share, between)), place in zip(shares.items(), places, strict=True):
        if between:
            exact = F.lit(share) * (F.col("_all") - 1)
            a, b, part = at(place[0]), at(place[1]), F.max(exact - place[0])
            out.append(F.when(a == b, a.cast("double")).otherwise(a + (b - a) * part).alias(name))
        else:
            out.append(at(place[0]).alias(name))
    return placed.groupBy(*keys).agg(*out)


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, of equally frequent ones the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    most = counts.groupBy(*keys).agg(F.max("_n").alias("_most"))
    if not keys:
        return counts.join(F.broadcast(most.select("_most"))).where("_n = _most").agg(F.min(value).alias("mode"))  # one row
    same = F.lit(True)
    for k in keys:
        same &= counts[k].eqNullSafe(most[k])
    return counts.join(most, same & (F.col("_n") == F.col("_most"))).groupBy(*[counts[k] for k in keys]).agg(F.min(value).alias("mode"))


def offset_rows(df: DataFrame, n: int) -> DataFrame:
    """OFFSET without an order: all rows but n of them, without bringing the rows into one task.

    The rows of each input partition are counted; only these counts reach the driver. The first partitions lose their rows.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    counts = numbered.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    left, at, rest = n, -1, 0
    for p, rows in counts:
        if left < rows:
            at, rest = p, left
            break
        left -= rows
    if at < 0:
        return df.where(F.lit(False)) if n else df
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.where((part > at) | (part == at) & (row >= rest)).drop("_id")


def fetch_first(df: DataFrame, n: int, order: Sequence[Column], offset: int = 0) -> DataFrame:
    """FETCH FIRST n ROWS ONLY, behind offset rows, by order: a top-n in each task, then of these."""
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def merge_sorted(parts: Sequence[DataFrame], order: Sequence[Column]) -> DataFrame:
    """The rows of several inputs of one schema in one order: a union under one range-partitioned sort."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*order)
