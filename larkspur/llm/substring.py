"""Substring deduplication: passages of many words that already stand in an earlier document.

1. Each document's windows are grouped into runs by the smallest hash of their short word grams. Equal windows have equal
   minima, so only runs whose minimum occurs in another document are looked at.
2. Equal runs are one; of the others, windows whose hash occurs in one document alone are cut off. What is left does not depend on
   the words around a passage, so a passage in any number of documents is a few pieces.
3. The pieces are dealt to shards by their minimum. Each shard builds FM-indexes over its pieces and streams the pieces
   against them: backward search gives the windows that also lie in a piece of an earlier document.

Words are compared by 64-bit hashes. A row is named by its key and the hash of its text, so several rows of one key are each
judged on their own against the rows of smaller keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, discard, grams, materialize, mix, slices, table
from .fm_index import FMIndex

#: Words in a window, and in the grams whose smallest hash names its run.
WINDOW, GRAM = 50, 8
#: Windows in a run, at most; longer runs of one minimum are cut.
LONGEST_RUN = 64
#: Words in one FM-index, about.
INDEX_WORDS = 400_000
#: Candidate pieces' words for one shard, about.
SHARD_WORDS = 1_000_000
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all windows across an array of word hashes."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _BASE)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - WINDOW, _INVERSE)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
        return mix((sums[WINDOW:] - sums[: n - WINDOW + 1]) * down)


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, behind the last window (both within the text) and minimum of each run."""
    counts = np.diff(words.offsets)
    low = sliding_minimum(grams(words.hashes, GRAM), WINDOW - GRAM + 1) if len(words.hashes) >= WINDOW else np.zeros(0, np.uint64)
    owner = words.by_text()
    at = np.flatnonzero(owner[: len(low)] == owner[WINDOW - 1 :]) if len(low) else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    m, o = low[at], owner[at]
    place = at - words.offsets[:-1][o]
    begin = np.r_[True, (m[1:] != m[:-1]) | (o[1:] != o[:-1])]
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
    begin |= since % LONGEST_RUN == 0
    first = np.flatnonzero(begin)
    size = np.diff(np.r_[first, len(at)])
    assert counts.sum() == len(words.hashes)
    return o[first], place[first], place[first] + size, m[first]


def scan(docs: DataFrame) -> DataFrame:
    """(id, x, n_words, t1, t2, kept_sha256, runs) of every document; t1 and t2 name its word sequence; the digest is of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words = Words(part)
                n = np.diff(words.offsets)
                place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], n)
                with np.errstate(over="ignore"):
                    names = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes + place.astype(np.uint64) * np.uint64(salt)))]) for salt in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)]
                t1, t2 = ((s[words.offsets[1:]] - s[words.offsets[:-1]]).view(np.int64) for s in names)
                shas = [hashlib.sha256(b" ".join(_bytes_of(part, words, k))).hexdigest() for k in range(len(part))]
                owner, first, stop, low = runs_of(words)
                edges = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(low.view(np.int64))], ["first", "stop", "m"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, len(part)) for c in (0, 2)), pa.array(n.astype(np.int64)), pa.array(t1), pa.array(t2), pa.array(shas), pa.ListArray.from_arrays(pa.array(edges), runs)], ["id", "x", "n_words", "t1", "t2", "kept_sha256", "runs"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "x").mapInArrow(run, f"id {kind}, x long, n_words long, t1 long, t2 long, kept_sha256 string, runs array<struct<first:int,stop:int,m:long>>")


def _bytes_of(part, words: Words, k: int) -> list[bytes]:
    """The words of the k-th text."""
    return bytes(part.data[part.offsets[k] : part.offsets[k + 1]]).split()


def run_words(candidates: DataFrame, kind: str) -> DataFrame:
    """(id, x, first, firsts, m, r1, r2, words, hashes) of each candidate run: its word hashes, its windows' hashes, and its name.

    A run that a document holds more than once is one row; firsts has all its places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words = Words(part)
                ids, texts, wanted = (batch.column(c).slice(part.first, len(part)).to_pylist() for c in (0, 2, 3))
                rows: list[list] = [[] for _ in range(9)]
                for k, spans in enumerate(wanted):
                    own = words.hashes[words.offsets[k] : words.offsets[k + 1]]
                    hashed = window_hashes(own)
                    places: dict[tuple, list[int]] = {}
                    for span in sorted(spans, key=lambda s: s["first"]):
                        h = hashed[span["first"] : span["stop"]]
                        with np.errstate(over="ignore"):
                            names = [int(np.add.reduce(mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(salt))).view(np.int64)) for salt in (3, 0x9E3779B97F4A7C15)]
                        if again := places.get((span["m"], *names)):
                            again.append(span["first"])
                            continue
                        firsts = places[span["m"], *names] = [span["first"]]
                        for column, value in zip(rows, [ids[k], texts[k], span["first"], firsts, span["m"], *names, own[span["first"] : span["stop"] + WINDOW - 1].tobytes(), h.view(np.int64)], strict=True):
                            column.append(value)
                types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                for at in range(0, len(rows[0]), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 5000], t) for c, t in zip(rows, types, strict=True)], ["id", "x", "first", "firsts", "m", "r1", "r2", "words", "hashes"])

    return candidates.mapInArrow(run, f"id {kind}, x long, first int, firsts array<int>, m long, r1 long, r2 long, words binary, hashes array<long>")


def cut_pieces(runs: DataFrame, kind: str) -> DataFrame:
    """(id, x, first, m, p1, p2, at, n, words): the stretches of shared windows (places) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for k, x, first, m, data, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, places = np.frombuffer(data, dtype=np.uint64), np.unique(np.array(places, dtype=np.int64))
                for stretch in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    at, n = int(stretch[0]), len(stretch)
                    part = own[at : at + n + WINDOW - 1]
                    with np.errstate(over="ignore"):
                        names = [int(np.add.reduce(mix(part + np.arange(len(part), dtype=np.uint64) * np.uint64(salt))).view(np.int64)) for salt in (3, 0x9E3779B97F4A7C15)]
                    for column, value in zip(rows, [k, x, first, m, *names, at, n, part.tobytes()], strict=True):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["id", "x", "first", "m", "p1", "p2", "at", "n", "words"])

    return runs.mapInArrow(run, f"id {kind}, x long, first int, m long, p1 long, p2 long, at int, n int, words binary")


def search_pieces(pieces: DataFrame, kind: str, shards: int) -> DataFrame:
    """(id, m, p1, p2, spans): the window intervals of each piece that also lie in a piece of a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def search() -> pa.RecordBatch:
            ids = sorted({h[0] for h in held})
            rank = {k: r for r, k in enumerate(ids)}
            owners = np.array([rank[h[0]] for h in held], dtype=np.int64)
            data = [np.frombuffer(h[4], dtype=np.uint64) for h in held]
            index = FMIndex(np.concatenate(data), np.array([len(d) for d in data], dtype=np.int64), owners)
            found = index.matches(owners, WINDOW)
            spans = pa.array([[{"a": a, "b": b} for a, b in f] for f in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], id_type), *(pa.array([h[c] for h in held], pa.int64()) for c in (1, 2, 3)), spans], ["id", "m", "p1", "p2", "spans"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > INDEX_WORDS and row[1] != last:  # pieces of one minimum stay in one index
                    yield search()
                    held, size = [], 0
                held.append(row)
                last = row[1]
                size += len(row[4]) // 8
        if held:
            yield search()

    return pieces.repartition(shards, "m").sortWithinPartitions("m").select("id", "m", "p1", "p2", "words").mapInArrow(run, f"id {kind}, m long, p1 long, p2 long, spans array<struct<a:int,b:int>>")


def cut_texts(found: DataFrame, kind: str) -> DataFrame:
    """(id, x, n_removed, sha, kept_text) of documents with their text and the intervals of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                names = [batch.column(c).slice(part.first, len(part)) for c in (0, 2)]
                removed, shas, texts = [], [], []
                for k, spans in enumerate(batch.column(3).slice(part.first, len(part)).to_pylist()):
                    words = bytes(part.data[part.offsets[k] : part.offsets[k + 1]]).split()
                    cut = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans:
                        cut[s["a"]] += 1
                        cut[s["b"] - 1 + WINDOW] -= 1
                    keep = np.flatnonzero(np.cumsum(cut[:-1]) == 0)
                    kept = b" ".join([words[i] for i in keep.tolist()])
                    removed.append(len(words) - len(keep))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                yield pa.RecordBatch.from_arrays([*names, pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts)], ["id", "x", "n_removed", "sha", "kept_text"])

    return found.mapInArrow(run, f"id {kind}, x long, n_removed long, sha string, kept_text string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, n_words, n_removed, kept_sha256, kept_text) of every row.

    text_hash is xxhash64 of the text; kept_text is null where nothing is removed: the text stays as it is. Null and empty texts
    have no words. A document whose words equal those of a smaller key loses them all if they fill a window. Rows that
    repeat a key, with the same text or another one, are judged each on their own and never against each other; a row
    with a null key stays as it is and removes nothing. A text of any length is read as a whole by one task. An empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("x"))
    kind = docs.schema["id"].dataType.simpleString()
    seen = materialize(scan(docs))
    # of rows with equal words, one of the smallest key stands for all; F.first drops exact repetitions where rows of a name meet
    classes = materialize(seen.where(F.col("id").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("t1", "t2", "n_words").agg(F.min(F.struct("id", "x")).alias("rep")).select("t1", "t2", "n_words", "rep.id", "rep.x"))
    own = seen.select("id", "x", "runs").join(classes.select("id", "x"), ["id", "x"], "left_semi").groupBy("id", "x").agg(F.first("runs").alias("runs"))
    runs = own.select("id", "x", F.explode("runs").alias("r")).select("id", "x", "r.first", "r.stop", "r.m")
    common = runs.groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("m")
    wanted = runs.join(common, "m").groupBy("id", "x").agg(F.collect_list(F.struct("first", "stop", "m")).alias("spans"))
    candidates = materialize(docs.join(wanted, ["id", "x"]).groupBy("id", "x").agg(F.first("text").alias("text"), F.first("spans").alias("spans")).select("id", "text", "x", "spans"))
    found = materialize(run_words(candidates, kind))

    equal = materialize(found.groupBy("m", "r1", "r2").agg(F.min(F.struct("id", "x", "first")).alias("rep"), F.max("id").alias("last")))
    heads = equal.select("rep.*", "last")
    single = materialize(found.join(heads, ["id", "x", "first"]).select("id", "x", "first", "m", "words", "hashes", "last"))
    windows = single.select("id", "x", "first", "last", F.posexplode("hashes").alias("place", "h"))
    shared = windows.groupBy("h").agg(F.min("id").alias("a"), F.max("last").alias("b")).where("a < b").select("h")
    places = windows.drop("last").join(shared, "h").groupBy("id", "x", "first").agg(F.collect_list("place").alias("places"))
    pieces = materialize(cut_pieces(single.join(places, ["id", "x", "first"]).select("id", "x", "first", "m", "words", "places"), kind))
    discard(single)

    piece_heads = materialize(pieces.groupBy("m", "p1", "p2").agg(F.min(F.struct("id", "x", "first", "at")).alias("rep"), F.first(F.octet_length("words")).alias("size")))
    total = piece_heads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // 8
    heads = pieces.join(piece_heads.select("rep.*"), ["id", "x", "first", "at"], "left_semi")
    searched = materialize(search_pieces(heads, kind, max(1, -(-total // SHARD_WORDS))))

    # a piece whose class's first one is in another document lies in an earlier document as a whole; one of the same
    # document has the intervals of the first one
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    of_piece = pieces.join(searched, ["id", "m", "p1", "p2"], "left").select("id", "x", "first", F.col("at").alias("shift"), F.explode(F.coalesce("spans", whole)).alias("s"))
    inside = of_piece.select("id", F.col("x").alias("rx"), F.col("first").alias("rf"), (F.col("shift") + F.col("s.a")).alias("a"), (F.col("shift") + F.col("s.b")).alias("b"))
    # so it is with runs
    placed = found.select("id", "x", "firsts", F.size("hashes").alias("n"), "m", "r1", "r2").join(equal, ["m", "r1", "r2"]).select("id", "x", "firsts", "n", F.col("rep.id").alias("ri"), F.col("rep.x").alias("rx"), F.col("rep.first").alias("rf"))
    of_heads = placed.where("ri = id").join(inside, ["id", "rx", "rf"]).select("id", "x", F.explode("firsts").alias("first"), "a", "b").select("id", "x", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    of_runs = placed.where("ri < id").select("id", "x", F.explode("firsts").alias("a"), "n").select("id", "x", "a", (F.col("a") + F.col("n")).alias("b"))
    spans = of_heads.union(of_runs).groupBy("id", "x").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = materialize(cut_texts(candidates.drop("spans").join(spans, ["id", "x"]).select("id", "text", "x", "spans"), kind))
    discard(candidates, found, equal, pieces, piece_heads, searched)

    reps = classes.select("t1", "t2", "n_words", F.col("id").alias("ri"), F.col("x").alias("rx"))
    copies = seen.select("id", "x", "n_words", "t1", "t2", "kept_sha256").join(reps, ["t1", "t2", "n_words"], "left").withColumn("copy", F.coalesce(F.col("ri") < F.col("id"), F.lit(False)))
    # a row has the cuts of the row of its key that stands for its words
    out = copies.withColumn("rx", F.when(F.col("ri") == F.col("id"), F.col("rx"))).join(cut.withColumnRenamed("x", "rx"), ["id", "rx"], "left")
    empty = F.sha2(F.lit(""), 256)
    return out.select(
        F.col("id").alias(key),
        F.col("x").alias("text_hash"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).when(F.col("n_removed") > 0, F.col("kept_text")).alias("kept_text"),
    )


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of 50 words and more that stand in an earlier document, from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text", "text_hash")


#: The same rows by SQL, with every window of every document as a row.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM win) WHERE m < doc_id),
cut AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS p FROM hit),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
