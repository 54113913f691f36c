"""Token counts of a piece vocabulary by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens at word marks, which no piece crosses. Pre-tokens that are not yet known go through the merge
loop together: their symbols lie in one array, and in each round every sequence applies the pair of lowest rank that it
holds at that moment, at all its places, in one vector step. What survives is counted; counts of known pre-tokens are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Known pre-tokens that a worker keeps; beyond it, it starts over.
KEPT = 800_000
#: Symbols that one merge loop holds, unless a single pre-token is longer.
LOOP_SYMBOLS = 1 << 18
OVER_LIMIT = 4096
_FAR = np.int64(1 << 62)
_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens as the piece model does: best-scored pair first, the leftmost of equals, unknown characters as bytes."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models without normalisation, with a leading mark and with byte fallback are covered")
        scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        order = {s: k for k, s in enumerate(sorted({-x for x in scores.values()}))}
        rank = {p: order[-s] for p, s in scores.items()}
        ids = {p: k for k, p in enumerate(scores)}
        self.known_chars = {p for p in scores if len(p) == 1}
        for p in list(scores):
            for ch in p:
                ids.setdefault(ch, len(ids))
        self.n = len(ids) + 1
        self.chars = {p: k for p, k in ids.items() if len(p) == 1}
        rows = [(ids[p[:i]] * self.n + ids[p[i:]], ids[p], rank[p]) for p in scores for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], dtype=np.int64)
        self.made = np.array([r[1] for r in rows], dtype=np.int64)
        self.rank = np.array([r[2] for r in rows], dtype=np.int64)
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece crosses a word mark")
        self.counts: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbours; a far rank where they don't merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _FAR), np.where(hit, self.made[at], -1)

    def count_unknown(self, words: list[str]) -> list[int]:
        """Token counts of pre-tokens, merged together; each begins with a mark."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sequence = np.repeat(np.arange(len(words)), size)
        chars = "".join(words)
        none = self.n - 1
        symbols = np.fromiter((self.chars.get(c, none) for c in chars), dtype=np.int64, count=len(chars))
        # characters without a piece of their own end as their bytes if nothing merges them
        cost = np.fromiter((1 if c in self.known_chars else len(c.encode()) for c in chars), dtype=np.int64, count=len(chars))
        done = np.zeros(len(words), dtype=np.int64)
        while len(symbols):
            rank, made = self._pairs(symbols[:-1], symbols[1:])
            rank[sequence[:-1] != sequence[1:]] = _FAR
            rank = np.append(rank, _FAR)
            made = np.append(made, -1)
            starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            over = lowest == _FAR
            if over.any():
                np.add.at(done, sequence[starts[over]], np.add.reduceat(cost, starts)[over])
                keep = np.repeat(~over, lengths)
                symbols, cost, sequence, rank, made = symbols[keep], cost[keep], sequence[keep], rank[keep], made[keep]
                if not len(symbols):
                    break
                lowest, lengths = lowest[~over], lengths[~over]
            least = np.repeat(lowest, lengths)
            at = np.flatnonzero(rank == least)
            # of overlapping places (x x x), every second one from the left merges; of different pairs with one rank, the leftmost
            run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            owner = sequence[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spread = np.diff(np.r_[first, len(at)])
            good = made[at] == np.repeat(made[at[first]], spread)
            # a merge may open a better pair with its neighbour, which goes before the places to the right
            new, last = made[at], len(symbols) - 1
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
            to_left, _ = self._pairs(symbols[before], new)
            to_right, _ = self._pairs(new, symbols[after])
            twice, _ = self._pairs(new, new)
            better = ((to_left <= least[at]) & (before < at) & (sequence[before] == owner)) | ((to_right <= least[at]) & (after == at + 2) & (sequence[after] == owner)) | (twice <= least[at])
            stop = better | ~good
            seen = np.cumsum(stop)
            seen_before = seen - stop - np.repeat(seen[first] - stop[first], spread)
            at = at[(seen_before == 0) & good]
            symbols[at] = made[at]
            cost[at] = 1
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, cost, sequence = symbols[keep], cost[keep], sequence[keep]
        return done.tolist()

    def learn(self, words: list[str]) -> None:
        """Count pre-tokens and keep the counts, in loops of bounded size, shortest first."""
        words.sort(key=len)
        held: list[str] = []
        size = 0
        for w in [*words, None]:
            if held and (w is None or size + len(w) > LOOP_SYMBOLS):
                self.counts.update(zip(held, self.count_unknown(held), strict=True))
                held, size = [], 0
            if w is not None:
                held.append(w)
                size += len(w)

    @staticmethod
    def cut(text: str) -> list[str]:
        """The pre-tokens of a text: a mark or more, then what follows up to the next mark."""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, marks = [], 0
        for w in words:
            if w:
                out.append(MARK * marks + w if marks else w)
                marks = 0
            else:
                marks += 1
        if marks:
            out.append(MARK * (marks - 1))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts. A pre-token is known by what follows its first mark."""
        if len(self.counts) > KEPT:
            self.counts.clear()
        counts, cut = self.counts, [self.cut(t) if t else [] for t in texts]
        unknown = {w for words in cut for w in words if w not in counts}
        if unknown:
            self.learn_tails(unknown)
        return [sum(map(counts.__getitem__, words)) for words in cut]

    def learn_tails(self, tails: set[str]) -> None:
        held, self.counts = self.counts, {}
        self.learn([MARK + t for t in tails])
        held.update((w[1:], n) for w, n in self.counts.items())
        self.counts = held


def counter(model: str) -> PieceCounter:
    """The worker's counter for a model file."""
    if model not in _loaded:
        _loaded[model] = PieceCounter(model)
    return _loaded[model]


def text_batches(column: pa.Array, limit: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of whole texts of about limit bytes; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield column[at:to].to_pylist()
        at = to


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = OVER_LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; null and empty texts have no bytes and no tokens.

    Repeated rows give equal rows. A text is counted as a whole by one task, however long; the merge loop's memory is bounded but
    for its longest pre-token. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model)
        for batch in batches:
            texts = batch.column(1)
            n = [c for part in text_batches(texts) for c in counts.count(part)]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            total = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, total, pc.greater(total, limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the 32k piece model."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
