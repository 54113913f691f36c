"""Shared pieces of the training-data operators: table access, shared-folder tables, text slices and word hashes."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls from tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that a vectorised step holds at once, unless one text alone is longer.
SLICE_BYTES = 2 << 20

#: Bytes of a word that the vectorised hash covers; longer words are hashed one by one.
LONG_WORD = 64

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_letters: dict[bool, np.ndarray] = {}
#: Tables that are still in the shared folder, by path.
_tables: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder. On a cluster the executors don't see such a folder, so there
    it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("name a folder that all executors see in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It cuts the lineage: what follows survives lost executors without computing df again. The table goes by discard, by
    release, or when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(release)
    _tables[path] = spark
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.larkspur_path = path
    return found


def summed(df: DataFrame, **sums: F.Column) -> tuple[DataFrame, dict]:
    """Materialize df, and the values of these aggregates over its rows, by one job."""
    seen = Observation()
    found = materialize(df.observe(seen, *[c.alias(k) for k, c in sums.items()]))
    return found, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for found in tables:
        if (spark := _tables.pop(found.larkspur_path, None)) is not None:
            drop(spark, found.larkspur_path)


def held() -> set[str]:
    """The tables that are in the shared folder now."""
    return set(_tables)


def release(keep: set[str] = frozenset()) -> None:
    """Delete all materialized tables but these."""
    for path in set(_tables) - keep:
        drop(_tables.pop(path), path)


def drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Texts:
    """Some consecutive texts of a column as one byte buffer; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole texts of about limit bytes, without a Python object per text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _letter_table(lower: bool) -> np.ndarray:
    """A random-looking 64-bit value for each place in a word (below LONG_WORD) and byte, as one row."""
    if lower not in _letters:
        with np.errstate(over="ignore"):
            rows = mix(mix(np.arange(LONG_WORD * 256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))).reshape(LONG_WORD, 256)
        _letters[lower] = np.ascontiguousarray(rows[:, _LOWER] if lower else rows).reshape(-1)
    return _letters[lower]


class Words:
    """The words of some texts: byte ranges, 64-bit hashes and word offsets by text."""

    def __init__(self, texts: Texts, lower: bool = False, hashes: bool = True):
        data = texts.data
        n = len(data)
        gap = _IS_SPACE[data]
        solid = ~gap
        begins = solid.copy()
        begins[1:] &= gap[:-1]
        inner = texts.offsets[1:-1]
        inner = inner[inner < n]
        begins[inner] = solid[inner]
        stops = solid
        stops[:-1] &= gap[1:]
        at_end = inner[inner > 0] - 1
        stops[at_end] = ~gap[at_end]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        #: Word number at which each text begins; one more entry than texts.
        self.offsets = np.searchsorted(self.starts, texts.offsets)
        if hashes:
            size = self.ends - self.starts
            edges = np.r_[self.starts, n]
            place = np.arange(n, dtype=np.int32) - np.repeat(np.r_[0, self.starts].astype(np.int32), np.diff(np.r_[0, edges]))
            place &= LONG_WORD - 1
            place <<= 8
            place |= data
            sums = np.zeros(n + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(_letter_table(lower)[place], out=sums[1:])
                self.hashes = mix(sums[self.ends] - sums[self.starts] + size.astype(np.uint64))
            for k in np.flatnonzero(size > LONG_WORD).tolist():
                word = (_LOWER[data[self.starts[k] : self.ends[k]]] if lower else data[self.starts[k] : self.ends[k]]).tobytes()
                self.hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")

    def by_text(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size consecutive entries, across the whole array."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
        return mix(out)
