"""Near-duplicate documents by b-bit MinHash.

Every document keeps the low bits of its minima, packed in a few 64-bit words. Bands of whole minima give candidates; their
similarity is estimated from the packed bits by counting, corrected for chance matches; likely pairs are confirmed on
the full shingle sets. Documents with equal sets are one class from the start, so copies never meet in pairs.

Links only matter as far as they connect. In the first round each class meets the smallest class of each of its buckets. A bucket
whose members are connected by then is done; in the others, a member picked by hash meets the rest. What is still
unconnected in a bucket then is compared by its rarest shingles only: of two sets at the limit, each has a shared one
among the rarest quarter. So a bucket of many pages from one form, all filled in differently, makes no pairs, and no
link between unconnected documents of a bucket is passed over.

Sets are sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, discard, grams, materialize, mix, slices, summed, table
from .components import components

#: Words in a shingle, and the similarity that links, in percent.
SHINGLE, PERCENT = 5, 75
#: Bands and minima in a band: a pair at the limit shares no band once in 200,000 times.
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum.
BITS = 2
#: Estimates from here are confirmed: five standard errors below the limit.
LEAST_ESTIMATE = 0.5
#: Members of a token's group that one task compares with the rest of the group.
GROUP_PART = 1000
_SEEDS = np.random.default_rng(20240).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_SIG_LONGS = BANDS * ROWS * BITS // 64


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and their offsets by text."""
    counts = np.diff(words.offsets)
    five = grams(words.hashes, SHINGLE)
    owner = words.by_text()
    if len(five):
        inside = owner[: len(five)] == owner[SHINGLE - 1 :]
        keys, texts = five[inside], owner[: len(five)][inside]
    else:
        keys, texts = five, owner[:0]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.array([mix(np.add.reduce(words.hashes[a:b] * np.arange(3, 2 * (b - a) + 3, 2, dtype=np.uint64), keepdims=True))[0] for a, b in zip(words.offsets[short], words.offsets[short + 1], strict=True)], dtype=np.uint64)
        keys, texts = np.concatenate([keys, whole]), np.concatenate([texts, short])
    order = np.lexsort((keys, texts))
    keys, texts = keys[order], texts[order]
    if len(keys):
        first = np.r_[True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])]
        keys, texts = keys[first], texts[first]
    return keys, np.searchsorted(texts, np.arange(len(counts) + 1))


def signatures(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and packed low bits for each non-empty set, in order."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    minima = np.empty((len(full), BANDS * ROWS), dtype=np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                h = keys * _SEEDS[0, k] + _SEEDS[1, k]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                minima[:, k] = np.minimum.reduceat(h, starts)
            minima = mix(minima)
            bands = np.zeros((len(full), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
    else:
        bands = np.zeros((0, BANDS), dtype=np.uint64)
    low = minima & np.uint64((1 << BITS) - 1)
    each = 64 // BITS
    packed = np.zeros((len(full), _SIG_LONGS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        packed[:, k // each] |= low[:, k] << np.uint64(BITS * (k % each))
    return bands.view(np.int64), packed.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, s1, s2, bands, sig) of every document: the set's size, 128 bits that name the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                keys, offsets = shingle_sets(Words(part, lower=True))
                n = np.diff(offsets)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(salt)))]) for salt in (11, 1 << 60)]
                names = [pa.array((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64)) for s in sums]
                bands, sig = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), _SIG_LONGS), np.int64)
                bands[n > 0], sig[n > 0] = signatures(keys, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(n.astype(np.int64)), *names, _lists(bands), _lists(sig)], ["id", "n_shingles", "s1", "s2", "bands", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>")


def full_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shingles) with the whole shingle set of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                keys, offsets = shingle_sets(Words(part, lower=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))], ["id", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two signatures: the share of equal low bits, less what chance gives."""
    odd = F.lit(0x5555555555555555)
    differ = lambda k: F.bit_count((F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))).bitwiseOR(F.shiftrightunsigned(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))), 1)).bitwiseAND(odd))
    total = differ(0)
    for k in range(1, _SIG_LONGS):
        total = total + differ(k)
    chance = 1 / (1 << BITS)
    return (1 - total / (BANDS * ROWS) - chance) / (1 - chance)


def similar(a: Column, b: Column) -> Column:
    """Whether two full sets are similar enough."""
    shared = F.size(F.array_intersect(a, b))
    return shared * 100 >= (F.size(a) + F.size(b) - shared) * PERCENT


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among pairs: first by the estimate from packed bits, then by the full sets of what is likely."""
    sig = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")).hint("merge")
    likely = pairs.join(sig("a"), "a").join(sig("b"), "b").where(estimate(F.col("sig_a"), F.col("sig_b")) >= LEAST_ESTIMATE).select("a", "b")
    return by_sets(likely, sets)


def by_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs by their full sets."""
    full = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")).hint("merge")
    likely = materialize(pairs.distinct())
    links = materialize(likely.join(full("a"), "a").join(full("b"), "b").where(similar(F.col("set_a"), F.col("set_b"))).select("a", "b"))
    discard(likely)
    return links


def open_buckets(buckets: DataFrame, joined: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, id, component) of the buckets whose members are not all connected, and the number of these rows."""
    placed = buckets.join(joined.hint("merge"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    spots = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("bucket")
    found, sums = summed(placed.join(spots.hint("merge"), "bucket"), n=F.count(F.lit(1)))
    return found, sums["n"]


def pairs_by_rare_shingles(nodes: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (id, component) in different components that may be similar, without a similar pair lost.

    Shingles that one component alone has come first in the order of rareness, as no such pair shares them. The first
    n - ceil(n * PERCENT / 100) + 1 of a set's n shingles then hold one of each set that is similar to it; and at the first
    shingle that two similar sets share, enough of both must be left behind it. Where a shingle's group is large, its
    members outside the largest component are dealt to several tasks.
    """
    of_node = nodes.join(sets.hint("merge"), "id").join(sigs.hint("merge"), "id").select("id", "component", "sig", "shingles", F.size("shingles").alias("size"), F.xxhash64("shingles").alias("v"))
    tokens = of_node.select("id", "v", "component", "size", F.explode("shingles").alias("t"))
    by_component = tokens.groupBy("t", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = by_component.groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tokens.join(groups.select("t", "n", "most", "main").hint("merge"), "t")
    ranked = shared.groupBy("id", "v", "component", "size").agg(F.array_sort(F.collect_list(F.struct("n", "t", "most", "main"))).alias("ts"))
    length = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1 - (F.col("size") - F.size("ts"))
    left = (F.size("ts") - F.col("place")).alias("left")  # shingles from this one on
    kept = ranked.where(length > 0).select("id", "component", "size", "ts", F.posexplode(F.slice("ts", F.lit(1), length.cast("int"))).alias("place", "x")).select("id", "component", "size", left, "x.*")
    kept = materialize(kept.join(sigs.hint("merge"), "id"))
    parts = (1 + (F.col("n") - F.col("most")) / GROUP_PART).cast("int")
    a = kept.where("component != main").select("t", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("id", "component", "size", "left", "sig")])
    b = kept.select("t", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "size", "left", "sig")])
    enough = F.least("left_a", "left_b") * (100 + PERCENT) >= (F.col("size_a") + F.col("size_b")) * PERCENT
    near = enough & (F.col("size_a") * 100 >= F.col("size_b") * PERCENT) & (F.col("size_b") * 100 >= F.col("size_a") * PERCENT) & (estimate(F.col("sig_a"), F.col("sig_b")) >= LEAST_ESTIMATE)
    return a.join(b.hint("merge"), ["t", "part"]).where((F.col("component_a") != F.col("component_b")) & near).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Null, empty and wordless texts have no shingles and are linked with nothing. Equal sets are one class; ties go to the
    smallest key; a row with a null key is kept. Rows that repeat a key are judged each by its own text: equal ones give equal
    rows, which are kept or not together. A text of any length is read as a whole by one task. An empty table gives no
    rows. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    seen = materialize(features(docs, "id", "text"))
    name = ["s1", "s2", "n_shingles"]
    classes = materialize(seen.where("n_shingles > 0").groupBy(*name).agg(F.min("id").alias("rep")))
    # F.first drops exact repetitions of a row, which meet here by the join's partitioning
    reps = seen.join(classes.withColumnRenamed("rep", "id").hint("merge"), ["id", *name], "left_semi").groupBy("id", *name).agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = materialize(reps.select("id", "bands", "sig"))
    members = reps.select("id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head != last").select("bucket", "head")
    buckets = materialize(members.join(shared.hint("merge"), "bucket"))  # the buckets that hold two classes or more
    wanted = materialize(buckets.select("id").distinct())
    sigs = materialize(reps.select("id", "sig").join(wanted.hint("merge"), "id", "left_semi"))
    discard(reps)
    texts = docs.join(wanted.hint("merge"), "id", "left_semi").groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text"))
    sets = materialize(full_sets(texts, "id", "text").where(F.size("shingles") > 0))

    # every class meets the smallest one of each of its buckets, then one picked by hash in the buckets still open
    links = confirmed(buckets.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), sigs, sets)
    joined = components(links)
    left, open_rows = open_buckets(buckets, joined)
    if open_rows:
        pick = left.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", "bucket")).alias("h")).select("bucket", F.col("h.id").alias("a"), F.col("h.component").alias("ca"))
        pairs = left.join(pick.hint("merge"), "bucket").where("component != ca").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        joined = components(confirmed(pairs, sigs, sets), known=joined)
        left, open_rows = open_buckets(buckets, joined)
    if open_rows:
        nodes = materialize(left.select("id", "component").distinct())
        joined = components(by_sets(pairs_by_rare_shingles(nodes, sigs, sets), sets), known=joined)

    # equal sets first, then the component of their class; the hot class is split by the join
    joined = joined.select(F.col("id").alias("rep"), "component")
    of_class = materialize(classes.join(joined.hint("merge"), "rep", "left").select(*name, F.coalesce("component", "rep").alias("component_id")))
    discard(buckets, wanted, sigs, sets)
    out = seen.select("id", *name).join(of_class.hint("merge"), name, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same rows by SQL, with every pair that shares a shingle as a row.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
