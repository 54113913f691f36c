"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected to their leading principal dimensions, which shrinks distances only. Sorted by the cells of a
grid as wide as the largest linking distance, close vectors lie in sequence intervals whose cells touch. The sorted
sequence is cut into blocks; block pairs with touching cells are joined by halving intervals, and interval pairs
that lie apart in any projected dimension are skipped. Copies of a vector are one row with a count from the start. A
block pair gives link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, summed, table
from .components import components

COSINE = 0.98
#: Leading dimensions that order the vectors, and vectors in a block and in a leaf of the recursion.
DIMS, BLOCK, LEAF = 8, 2048, 64
#: Vectors from which the principal dimensions are estimated, at most; they only guide the order, links don't depend on them.
BASIS_ROWS = 10_000
#: Cosines this close to the limit are computed again, one by one.
CLOSE = 1e-9


def reach(cosine: float = COSINE) -> float:
    """The distance of unit vectors at the limit, with room for rounding."""
    return float(np.sqrt(2 - 2 * cosine)) + 1e-7


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first to largest component 1, so that no square overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def basis_of(rows: list[tuple]) -> dict[int, np.ndarray]:
    """Principal dimensions within labels, by vector length, from (label, vector) rows."""
    by_width: dict[int, dict] = {}
    for label, v in rows:
        by_width.setdefault(len(v), {}).setdefault(label, []).append(v)
    out = {}
    for width, groups in by_width.items():
        x = np.concatenate([(u := units(np.array(g))) - u.mean(axis=0) for g in groups.values()])
        # by subspace iteration, whose memory grows with the width and not with its square
        basis = np.random.default_rng(1).normal(size=(width, min(width, 2 * DIMS)))
        for _ in range(8):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        out[width] = np.ascontiguousarray((basis @ turn.T)[:, :DIMS])
    return out


def basis_from(classes: DataFrame, rows: int = BASIS_ROWS) -> dict[int, np.ndarray]:
    """The principal dimensions of at most rows classes, those whose numbers hash lowest, found in one task."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(k, v.values.to_numpy()) for batch in batches for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        for width, basis in basis_of(seen).items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([basis.astype("<f8").tobytes()])], ["width", "basis"])

    sample = classes.orderBy(F.xxhash64("label", "embedding"), "c").limit(rows).select(F.xxhash64("label"), "embedding").repartition(1)
    return {r["width"]: np.frombuffer(r["basis"], "<f8").reshape(r["width"], -1) for r in sample.mapInArrow(fit, "width int, basis binary").collect()}


def project(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """The leading coordinates; vectors of a length that the sample had none of keep their first ones."""
    got = x @ basis if basis is not None else x[:, :DIMS]
    return np.pad(got, ((0, 0), (0, DIMS - got.shape[1])))


def halves_apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    return bool(((a.min(axis=0) - b.max(axis=0) > eps) | (b.min(axis=0) - a.max(axis=0) > eps)).any())


def join_intervals(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Linked places (i, j) of two sequences of unit vectors x, y with projections cx, cy; i < j if they are the same."""
    eps, found = reach(cosine), []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d or same and d <= a or halves_apart(cx[a:b], cy[c:d], eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        got = x[a:b] @ y[c:d].T
        i, j = np.nonzero(got >= cosine - CLOSE)
        if len(i):
            unsure = np.abs(got[i, j] - cosine) < CLOSE
            i, j = i + a, j + c
            good = np.ones(len(i), dtype=bool)
            for k in np.flatnonzero(unsure):
                p, q = x[i[k]], y[j[k]]
                good[k] = float(p @ q) / np.sqrt(float(p @ p) * float(q @ q)) >= cosine
            if same:
                good &= i < j
            found.append((i[good], j[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places reaches by links."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            return low


def blocks_of(classes: DataFrame, basis: dict[int, np.ndarray], parts: int) -> DataFrame:
    """The classes in epsilon grid order, cut into blocks of at most BLOCK, each with the box of its projections."""
    sent = classes.sparkSession.sparkContext.broadcast(basis)
    eps = reach()
    cells = [f"cell{k}" for k in range(DIMS)]
    kind, element = classes.schema["label"].dataType.simpleString(), classes.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(4)], dtype=np.int64)
            for w in np.unique(widths):
                part = batch.filter(pa.array(widths == w))
                at = np.floor(project(units(matrix(part.column(4), int(w))), sent.value.get(int(w))) / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(at[:, k]) for k in range(DIMS)), part.column(4)], ["c", "n", "label", "width", *cells, "embedding"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial, held, last = TaskContext.get().partitionId() << 32, 0, [], None

        def block() -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            width = last[1]
            raw = np.array([h[2] for h in held])
            c = project(units(raw), sent.value.get(width))
            values = [base + serial, last[0], width, len(held), [h[0] for h in held], [h[1] for h in held], raw.tobytes(), c.min(axis=0).tolist(), c.max(axis=0).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        types, names = None, ["block", "label", "width", "size", "classes", "counts", "vectors", "low", "high"]
        for batch in batches:
            types = [pa.int64(), batch.schema.field(2).type, pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            vectors = batch.column(4)
            for k, (c, n, label, width) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if held and ((label, width) != last or len(held) == BLOCK):
                    yield block()
                    held = []
                last = (label, width)
                held.append((c, n, vectors[k].values.to_numpy()))
        if held:
            yield block()

    placed = classes.select("c", "n", "label", F.size("embedding").alias("width"), "embedding").mapInArrow(place, f"c long, n long, label {kind}, width int, {', '.join(c + ' int' for c in cells)}, embedding {element}")
    keys = ["label", "width", *cells, "c"]
    ordered = materialize(placed).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("c", "n", "label", "width", "embedding")
    return ordered.mapInArrow(cut, f"block long, label {kind}, width int, size int, classes array<long>, counts array<long>, vectors binary, low array<double>, high array<double>")


def join_blocks(blocks: DataFrame, basis: dict[int, np.ndarray], double: bool) -> DataFrame:
    """(id, links, root): for each block pair, how many vectors each class links to, and the smallest class it reaches there."""
    sent = blocks.sparkSession.sparkContext.broadcast(basis)
    eps = reach()
    stripe = lambda c, k: F.floor(F.get(F.col(c), F.lit(0)) / eps).cast("int") + k
    boxes = blocks.select("block", "label", "width", "low", "high")
    left = boxes.select(F.col("block").alias("a"), "label", "width", F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(stripe("low", 0), stripe("high", 0))).alias("stripe"))
    right = boxes.select(F.col("block").alias("b"), "label", "width", F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(stripe("low", -1), stripe("high", 1))).alias("stripe"))
    touch = F.lit(True)
    for k in range(DIMS):
        touch &= (F.get("la", F.lit(k)) - F.get("hb", F.lit(k)) <= eps) & (F.get("lb", F.lit(k)) - F.get("ha", F.lit(k)) <= eps)
    pairs = left.join(right, ["label", "width", "stripe"]).where((F.col("a") <= F.col("b")) & touch).select("a", "b").distinct()
    body = ["classes", "counts", "vectors"]
    first = blocks.select(F.col("block").alias("a"), "width", *[F.col(c).alias(f"{c}_a") for c in body])
    second = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}_b") for c in body])
    rows = materialize(pairs).join(first, "a").join(second, "b").select("a", "b", "width", *[f"{c}_{s}" for s in "ab" for c in body])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, width = (batch.column(c)[k].as_py() for c in range(3))
                sides = []
                for c in (3, 6):
                    raw = np.frombuffer(batch.column(c + 2)[k].as_buffer(), dtype=np.float64 if double else np.float32).reshape(-1, width)
                    x = units(raw)
                    sides.append((batch.column(c)[k].values.to_numpy(), batch.column(c + 1)[k].values.to_numpy(), x, project(x, sent.value.get(width))))
                (ra, na, x, cx), (rb, nb, y, cy) = sides
                i, j = join_intervals(x, cx, y, cy, a == b)
                if not len(i):
                    continue
                shift = 0 if a == b else len(ra)
                ids, j_all = (ra, j) if a == b else (np.concatenate([ra, rb]), j + shift)
                links = np.bincount(i, weights=nb[j], minlength=len(ids)) + np.bincount(j_all, weights=na[i], minlength=len(ids))
                order = np.argsort(ids)
                place = np.empty(len(ids), dtype=np.int64)
                place[order] = np.arange(len(ids))
                root = ids[order][forest(place[i], place[j_all], len(ids))[place]]
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["id", "links", "root"])

    return rows.mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors that are null, empty or zero, hold nulls or non-finite components, or have a null label link with nothing; so do
    vectors of different lengths. Copies link with each other; so do rows that repeat a key, each of which counts as a vector;
    a row with a null key is kept. A vector of any length is compared as a whole. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    double = rows.schema["embedding"].dataType.elementType.simpleString() == "double"
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False))
    named = rows.select("id", "label", "embedding", usable.alias("usable"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", "label", F.lit(7)).alias("h2"))
    # rows of equal label and vector are one class, which has a number of its own from here on
    groups = named.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes, sums = summed(groups.withColumn("c", F.monotonically_increasing_id()), total=F.count(F.lit(1)))
    basis = basis_from(classes)
    blocks = materialize(blocks_of(classes, basis, max(1, -(-sums["total"] // (8 * BLOCK)))))
    near = materialize(join_blocks(blocks, basis, double))
    counts = near.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(near.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("c"), "component")
    of_class = classes.select("h1", "h2", "c", "rep", "n")
    least = materialize(joined.join(of_class.select("c", "rep"), "c").groupBy("component").agg(F.min("rep").alias("least")))
    found = of_class.join(counts.select(F.col("id").alias("c"), "links"), "c", "left").join(joined.join(least, "component").select("c", "least"), "c", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    found = materialize(found)
    discard(classes, blocks, near, least)
    single = F.col("usable")
    out = named.select("id", "usable", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(single, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.when(single, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 and more among all vectors of equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The same rows by SQL, all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reached GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
