"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words, of neighbouring word pairs, and of word pairs with one
word between. The learner keeps a learning rate for each coordinate; its L1 term leaves few weights, which are sent to the
workers as two sorted arrays. It learns in one task from a bounded sample of the labelled rows; the driver gets the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, Words, mix, slices, table

#: Buckets of hashed features.
BUCKETS = 1 << 22
#: Labelled rows that the learner sees, at most: those whose key hashes lowest, a sample that doesn't depend on order.
TRAIN_ROWS = 12_000
#: Features of fewer sampled rows are not learned.
LEAST_ROWS = 3
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.5
THRESHOLD = 0.3
_SKIP, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature buckets, each bucket once per text, in order of text."""
    words = Words(texts, lower=True)
    h, owner = words.hashes, words.by_text()
    kinds = [(owner, h)]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, _PAIR), (2, _SKIP)):
            if len(h) > gap:
                same = owner[gap:] == owner[:-gap]
                kinds.append((owner[gap:][same], mix(h[:-gap] * salt + h[gap:])[same]))
    key = np.concatenate([o.astype(np.uint64) << np.uint64(32) | (f >> np.uint64(40 - 18)) % np.uint64(BUCKETS) for o, f in kinds])
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def learn(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by FTRL-proximal from (label, distinct buckets) rows: sorted buckets, their weights, the bias.

    Without rows the weights are empty and the bias gives scores near 0.
    """
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), -4.0
    count = np.zeros(BUCKETS, dtype=np.int32)
    for _, f in rows:
        count[f] += 1
    seen = np.flatnonzero(count >= LEAST_ROWS)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[seen] = np.arange(len(seen))
    local = [(y, at[at >= 0]) for y, at in ((y, place[f]) for y, f in rows)]
    z, n = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    bias = len(seen)

    def weights(at: np.ndarray) -> np.ndarray:
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        free = np.where(at == bias, 0.0, L1)
        return np.where(np.abs(z[at]) <= free, 0.0, (np.sign(z[at]) * free - z[at]) / rate)

    order = np.random.default_rng(7)  # a fixed order of presentation
    for _ in range(EPOCHS):
        for k in order.permutation(len(local)):
            y, f = local[k]
            at = np.r_[f, bias]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(seen) + 1))
    kept = np.flatnonzero(w[:-1])
    return seen[kept], w[kept], float(w[-1])


def score_texts(texts: Texts, buckets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    owner, f = features(texts)
    at = np.minimum(np.searchsorted(buckets, f), max(len(buckets) - 1, 0))
    total = np.full(len(texts), bias)
    if len(buckets):
        hit = buckets[at] == f
        total += np.bincount(owner[hit], weights=weights[at[hit]], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def in_training(key: F.Column) -> F.Column:
    """Whether labels of a key may be learned from: its text's CRC-32 has not the remainder 2 by 4."""
    return F.crc32(key.cast("string")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from at most rows labelled rows, in one task.

    Null labels teach nothing; repeated labels of a key teach as one, by their maximum, and repeated rows of a document by
    their least text. Null texts have no features. Empty tables give the model without weights. A text of any length
    is read in one piece; it has at most BUCKETS features.
    """
    sample = (
        labels.where(F.col(label).isNotNull() & in_training(F.col(key)))
        .join(docs.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(key), key)
        .limit(rows)
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for part in slices(batch.column(1)):
                owner, f = features(part)
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                f = f.astype(np.int32)
                seen += [(y, f[a:b].copy()) for y, a, b in zip(batch.column(0).slice(part.first, len(part)).to_pylist(), edges[:-1], edges[1:], strict=True)]
        buckets, weights, bias = learn(seen)
        yield pa.RecordBatch.from_arrays([pa.array([buckets.astype("<i8").tobytes()]), pa.array([weights.astype("<f8").tobytes()]), pa.array([bias])], ["buckets", "weights", "bias"])

    # the sample has a fixed size, so it is sent to the documents; a key that many rows have teaches once, by its least text
    found = docs.select(key, text).join(F.broadcast(sample), key).groupBy(F.xxhash64(key).alias("o"), key).agg(F.min("y").alias("y"), F.min(text).alias("t"))
    model = found.repartition(1).sortWithinPartitions("o", key).select("y", "t").mapInArrow(fit, "buckets binary, weights binary, bias double").collect()
    if not model:  # an empty table has no task
        return learn([])
    return np.frombuffer(model[0]["buckets"], "<i8"), np.frombuffer(model[0]["weights"], "<f8"), model[0]["bias"]


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", to: str = "score") -> DataFrame:
    """Add the score of every row, in place of a column of that name if there is one.

    Null and empty texts get the score of no features. Repeated rows get equal scores, each its own; an empty table gives
    no rows. A text of any length is read as a whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                rows = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(score_texts(part, *sent.value))], [*(f.name for f in others), to])

    return docs.select(F.col(text).alias("_text"), *[f.name for f in others]).mapInArrow(run, T.StructType([*others, T.StructField(to, T.DoubleType())]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row. Null and empty texts get the score of no features, repeated rows equal ones; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(score_texts(part, *sent.value))], ["k", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; learn from the labelled rows that are not held out. A null doc_id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
