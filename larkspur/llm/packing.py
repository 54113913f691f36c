"""Sequence packing along a space-filling curve.

Hashed word counts of each document are projected to a few dimensions; the Hilbert key of that point orders the documents
so that neighbours on the curve are alike. Partitions of the curve are packed side by side: the documents of a
partition form one stream of ids that is cut every 1024 ids, and the rest at the end is cut into powers of two, so that
no sequence needs padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, Words, materialize, slices, table
from .token_count import text_batches

#: Ids of a full sequence; a power of two.
SEQUENCE = 1024
#: The id that ends every document.
END_ID = 0
#: Dimensions of the projection, and bits of each coordinate.
DIMS, BITS = 4, 12
#: Ids in one partition of the curve, about; ids that one entry of the sample for its bounds stands for; bounds at most.
PARTITION_IDS, SAMPLE_IDS, RANGES = 4 << 20, 1 << 14, 1024
_encoders: dict[str, Encoder] = {}


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row each, with coordinates below 2**bits."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:  # undo the turns of the sub-cubes, largest first
        low = level - 1
        for d in range(dims):
            high = (x[:, d] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[:, dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> b & 1)
    return key


def curve_keys(texts: Texts) -> np.ndarray:
    """Hilbert keys of texts: signed sums of their word hashes, scaled by length; texts without words lie at the centre."""
    words = Words(texts)
    n = np.diff(words.offsets)
    points = np.zeros((len(texts), DIMS), dtype=np.int64)
    for d in range(DIMS):
        signs = ((words.hashes >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.r_[0, np.cumsum(signs)]
        spread = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / np.sqrt(np.maximum(n, 1))
        points[:, d] = np.clip((spread + 8) / 16 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(points)


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, by tiktoken's faster merging.

    Both apply the merge of lowest rank first; the file is only taken if its merges are listed by id, so that ids are
    ranks. Special strings inside texts become their ids, as the library has it.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are covered")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = byte_letters()
        vocab = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges are not in order of id")
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens=special)
        self.special = set(special)
        self.ids = np.dtype("<u2" if max([*vocab.values(), *special.values()]) < 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end id, in the smallest type that holds the vocabulary."""
        return [np.array([*self.bpe.encode(t, allowed_special=self.special, disallowed_special=()), END_ID], dtype=self.ids) for t in texts]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(key, curve, n_ids, ids) of every document; ids are packed as little-endian numbers, the end id last."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            curve = np.concatenate([curve_keys(t) for t in slices(batch.column(1))] or [np.zeros(0, np.int64)])
            at = 0
            for texts in text_batches(batch.column(1)):
                ids = known.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(curve[at : at + len(texts)]), pa.array([len(p) for p in ids], pa.int64()), pa.array([p.tobytes() for p in ids], pa.binary())], ["k", "curve", "n_ids", "ids"])
                at += len(texts)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, curve long, n_ids long, ids binary")


def cut_points(total: int) -> np.ndarray:
    """Where the sequences of a stream of total ids begin, and total: full ones, then the rest by powers of two."""
    full, rest = divmod(total, SEQUENCE)
    sizes = [SEQUENCE] * full + [1 << b for b in range(SEQUENCE.bit_length() - 2, -1, -1) if rest >> b & 1]
    return np.cumsum([0, *sizes])


def partition_of(ids: DataFrame) -> tuple[Column, int]:
    """The partition of each document, in order of the curve, and their number: about PARTITION_IDS ids in each.

    The curve is cut into at most RANGES ranges of about equally many ids, by a sample that takes documents in proportion to
    their ids. A range that holds more than a partition's ids, as one of many copies does, is dealt over several by key. The
    driver gets the bounds and sums of the ranges.
    """
    entries = F.floor((F.col("n_ids") + F.pmod(F.xxhash64("k"), F.lit(SAMPLE_IDS))) / SAMPLE_IDS).cast("int")
    total = ids.agg(F.coalesce(F.sum("n_ids"), F.lit(0))).first()[0]
    ranges = min(RANGES, max(1, round(total / PARTITION_IDS)))
    bounds: list[int] = []
    if ranges > 1:
        sample = ids.select("curve", entries.alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(1), F.col("n"))), "curve")
        shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
        bounds = sorted(set(sample.agg(F.percentile_approx("curve", shares, F.lit(10_000)).alias("b")).first()["b"] or ()))
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("curve"))) if bounds else F.lit(0)
    sums = dict(ids.groupBy(number.alias("r")).agg(F.sum("n_ids")).collect())
    spread = [max(1, round(sums.get(r, 0) / PARTITION_IDS)) for r in range(len(bounds) + 1)]
    first = np.cumsum([0, *spread])
    at = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), number)
    return (at(first[:-1]) + F.pmod(F.xxhash64("k"), at(spread))).cast("int"), int(first[-1])


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences; one row per piece.

    Columns: key, start (its document's ids before it), length, doc_tokens, sequence_id, offset (in the sequence) and
    ids (32-bit little-endian). Null and empty texts are the end id alone; an empty table gives no rows; repeated texts lie next to
    each other, many of them in partitions by key. Repeated rows, null keys, too, are packed one by one. A text is
    encoded as a whole by one task, however long. Other columns are ignored.
    """
    kind = docs.schema[key].dataType
    ids = materialize(tokenized(docs, path, key, text))
    number, parts = partition_of(ids)
    schema = T.StructType([T.StructField("k", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])
    step = 256 * SEQUENCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 36, 0
        held: list[list] = []  # documents not yet packed: key, ids already packed, all ids
        size = 0

        def out(final: bool) -> pa.RecordBatch:
            nonlocal held, size, serial
            points = cut_points(size) if final else np.arange(0, size // SEQUENCE + 1) * SEQUENCE
            edges = np.cumsum([0, *(len(d[2]) - d[1] for d in held)])
            starts = np.unique(np.r_[points[:-1], edges[:-1][edges[:-1] < points[-1]]])
            stops = np.r_[starts[1:], points[-1]]
            doc = np.searchsorted(edges, starts, "right") - 1
            sequence = np.searchsorted(points, starts, "right") - 1
            skip = np.array([d[1] for d in held], dtype=np.int64)
            begin = starts - edges[doc] + skip[doc]
            length = stops - starts
            parts = [held[d][2][b : b + n].astype("<u4").tobytes() for d, b, n in zip(doc.tolist(), begin.tolist(), length.tolist(), strict=True)]
            tokens = np.array([len(d[2]) for d in held], dtype=np.int64)[doc]
            got = [pa.array([held[d][0] for d in doc.tolist()], key_type), pa.array(begin), pa.array(length), pa.array(tokens), pa.array(base + serial + sequence), pa.array(starts - points[sequence]), pa.array(parts, pa.binary())]
            serial += len(points) - 1
            rest = size - int(points[-1])
            if rest:
                first = int(np.searchsorted(edges, points[-1], "right")) - 1
                held = held[first:]
                held[0][1] += int(points[-1] - edges[first])
            else:
                held = []
            size = rest
            return pa.RecordBatch.from_arrays(got, schema.names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            kind = encoder(path).ids
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append([k, 0, np.frombuffer(i, dtype=kind)])
                size += len(held[-1][2])
                if size >= step:
                    yield out(False)
        if size:
            yield out(True)

    return ids.repartitionById(parts, number).sortWithinPartitions("curve", "k").select("k", "ids").mapInArrow(run, schema).withColumnRenamed("k", key)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents by the 50k byte-level tokenizer."""
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
