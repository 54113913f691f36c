"""Byte-level BPE by prefix dynamic programming.

For every prefix of a pre-token exactly one token can end its encoding. The table of these last tokens is filled from left
to right: a token may follow a shorter prefix if no merge reaches across their border before the two are whole. Reading
the table backwards gives the encoding; a longer text only adds entries, and behind an edit the old entries hold
again as soon as they agree over the length of the longest token.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkEncoder
from .common import table
from .token_count import text_batches

#: White space as Unicode has it, the same in every pattern library.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Bytes of known pattern matches in one generation of a worker; the last two generations are kept. ENTRY: of a place in a dict.
KEPT_BYTES, ENTRY = 72 << 20, 80
#: Known pairs of tokens.
KEPT_PAIRS = 400_000
#: Known chunks in one generation; finding their matches again is cheap.
KEPT_CHUNKS = 60_000
#: Bytes of text that are encoded, and ids that are decoded, at once, unless one row alone is longer.
TEXT_BYTES, IDS = 2 << 20, 1 << 18
_loaded: dict[tuple[str, str], tuple[ByteBPE, ChunkEncoder]] = {}
_tokens: dict[str, TokenBytes] = {}


def portable(pattern: str) -> str:
    """The pattern with white space spelled out."""
    out, in_class, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(WHITE if in_class else f"[{WHITE}]")
            k += 2
        elif two == r"\S" and not in_class:
            out.append(f"[^{WHITE}]")
            k += 2
        elif two[:1] == "\\":
            out.append(two)
            k += 2
        else:
            in_class = pattern[k] == "[" or in_class and pattern[k] != "]"
            out.append(pattern[k])
            k += 1
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for one rank table and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(portable(pattern))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.usable[token] = rank
                continue
            halves = self._halves(token)
            if halves:
                self.parts[rank] = halves
                self.joined[halves] = rank
                self.usable[token] = rank
        self.longest = max(map(len, self.usable))
        #: Token of each byte string that begins a token; -1 where it only begins one.
        self.begins: dict[bytes, int] = {token[:k]: -1 for token in self.usable for k in range(1, len(token))} | self.usable
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, or None for a token that merging never makes."""
        ids = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(ids) > 2:
            found = [(r, k) for k in range(len(ids) - 1) if (r := self.joined.get((ids[k], ids[k + 1]))) is not None]
            if not found:
                return None
            rank, k = min(found)
            ids[k : k + 2] = [rank]
        if len(ids) != 2 or self.bytes_of[ids[0]] + self.bytes_of[ids[1]] != token:
            return None
        return ids[0], ids[1]

    def follows(self, left: int, right: int) -> bool:
        """Whether right can stand behind left: undoing their merges from the last one back, no pair at the border merges earlier."""
        bound = 1 << 62
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < bound:
                return False
            open_left, open_right = self.parts.get(left), self.parts.get(right)
            if open_left is None and open_right is None:
                return True
            # the younger of the two came apart last; of equals, the right one, as merges run from the left
            if open_right is None or open_left is not None and left > right:
                bound, left = left, open_left[1]
            else:
                bound, right = right + 1, open_right[0]

    def table_for(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of every prefix of data; last is the table of a shorter prefix, which is carried on."""
        n = len(data)
        done = len(last) - 1 if last else 0
        out = [-1] * (n + 1)
        if last:
            out[: done + 1] = last
        token_of, fits, open_places = self.begins.get, self.fits.get, n - done
        for j in range(max(0, done - self.longest), n):
            if not open_places:
                break
            before = out[j] << 32
            for to in range(j + 1, n + 1):
                if out[to] >= 0:
                    continue
                token = token_of(data[j:to])
                if token is None:
                    break
                if token >= 0:
                    fit = not j or fits(before | token)
                    if fit is None:
                        fit = self._learn_fit(out[j], token)
                    if fit:
                        out[to] = token
                        open_places -= 1
        return out

    def _learn_fit(self, left: int, right: int) -> bool:
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        fit = self.fits[left << 32 | right] = self.follows(left, right)
        return fit

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, at, bytes_of = [], len(last) - 1, self.bytes_of
        while at:
            token = last[at]
            out.append(token)
            at -= len(bytes_of[token])
        return out[::-1]

    def edited(self, data: bytes, last: list[int], start: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """data with data[start:end] replaced, and its table, computed only around the edit."""
        new, shift = data[:start] + put + data[end:], len(put) - (end - start)
        out, agreed, at = last[: start + 1], 0, start
        while at < len(new):
            at += 1
            out = self.table_for(new[:at], out)
            old = at - shift
            agreed = agreed + 1 if old > end and old < len(last) and out[at] == last[old] else 0
            if agreed >= self.longest:
                return new, out + last[old + 1 :]
        return new, out

    def encode_piece(self, piece: str) -> bytes:
        """One match of the pattern as packed ids; a match that is a token itself is that token."""
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.read_back(self.table_for(data))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, one match of the pattern after the other."""
        out, known = [], self.known
        for text in texts:
            parts = []
            for piece in self.pattern.findall(text):
                ids = known.get(piece)
                if ids is None:
                    ids = self.older.get(piece) or self.encode_piece(piece)
                    if len(piece) < 64:
                        known = self._keep(piece, ids)
                parts.append(ids)
            out.append(b"".join(parts))
        return out

    def _keep(self, piece: str, ids: bytes) -> dict[str, bytes]:
        """The known matches with this one among them; a full generation becomes the older one."""
        size = getsizeof(piece) + getsizeof(ids) + ENTRY
        if self.held + size > KEPT_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        self.held += size
        self.known[piece] = ids
        return self.known

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TokenBytes:
    """The bytes of all tokens of a rank table as one array, for decoding without an object per id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sizes = np.full(max(ranks.values()) + 1, -1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        held = np.maximum(self.sizes, 0)
        self.starts = np.cumsum(held) - held
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids; of null, none."""
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        flat = flat.to_numpy()
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.sizes) or (self.sizes[flat] < 0).any()):
            raise ValueError("an id is not in the rank file")
        sizes = self.sizes[flat]
        ends = np.r_[0, np.cumsum(sizes)]
        place = np.repeat(self.starts[flat] - ends[:-1], sizes)
        place += np.arange(len(place))
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = ends[np.r_[0, np.cumsum(counts, dtype=np.int64)]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[place])])


def token_bytes(ranks_path: str) -> TokenBytes:
    """The worker's token bytes of a rank file."""
    if ranks_path not in _tokens:
        _tokens[ranks_path] = TokenBytes(read_ranks(ranks_path))
    return _tokens[ranks_path]


def runs(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Where to cut rows of these counts into runs of about limit, or of one row alone that has more."""
    ends, at = np.cumsum(counts, dtype=np.int64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def worker_codec(ranks_path: str, pattern: str) -> tuple[ByteBPE, ChunkEncoder]:
    """The worker's codec for a rank file, with its known chunks."""
    key = (ranks_path, pattern)
    if key not in _loaded:
        codec = ByteBPE(read_ranks(ranks_path), pattern)
        _loaded[key] = codec, ChunkEncoder(codec.encode_many, KEPT_CHUNKS)
    return _loaded[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """(key, ids) of every row; null and empty texts have no ids.

    decoded names a third column, the bytes that the ids stand for: as from decode, but by the same worker, as a further step in
    Python takes as many workers again.

    Repeated rows give equal rows. A text is encoded as a whole by one task, however long; memory follows its longest match of the
    pattern and its ids. An empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunks = worker_codec(ranks_path, pattern)
        tokens = token_bytes(ranks_path) if decoded else None
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column(1), TEXT_BYTES):
                packed = chunks.encode(texts)
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                columns = [batch.column(0).slice(at, len(texts)), ids]
                yield pa.RecordBatch.from_arrays([*columns, tokens.decode(ids)], ["k", "ids", "d"]) if tokens else pa.RecordBatch.from_arrays(columns, ["k", "ids"])
                at += len(texts)

    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>" + (", d binary" if decoded else ""))
    return found.withColumnsRenamed({"k": key, "d": decoded} if decoded else {"k": key})


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for, in place of a column of that name if there is one.

    Null ids give no bytes; bytes that are no UTF-8 stay as they are. Repeated rows give equal bytes each; an empty table gives
    no rows. A row's ids are decoded as a whole, however many.
    """
    others = [f for f in encoded.schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(ranks_path)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for at, end in runs(counts, IDS):
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], tokens.decode(part.column(0))], [*(f.name for f in others), to])

    return encoded.select(F.col(ids).alias("_ids"), *[f.name for f in others]).mapInArrow(run, T.StructType([*others, T.StructField(to, T.BinaryType())]))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents by the multilingual ranks, decode the ids, and digest both."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(table(spark, sf_dir, "documents"), path, pattern, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
