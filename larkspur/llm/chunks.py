"""Encoding of whole texts chunk by chunk, with known chunks kept.

In a byte-level pattern a space before a character that is no white space always begins a new match. So a text can be cut
at such spaces, the chunks encoded on their own, and the results joined. Most chunks of a corpus are frequent words, which
makes encoding a lookup. A text with any other space (before white space or at the end) is encoded in one piece.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress, repeat
from operator import is_

#: Known chunks in one generation of a worker, of which the last two are kept, and the longest chunk that it keeps.
KEPT, LONGEST = 500_000, 64


class ChunkEncoder:
    """encode_many gets unknown chunks and returns their ids as little-endian 32-bit bytes; it gets odd texts whole, too."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.encode_many = encode_many
        self.kept = kept
        self.after_space: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.after_space) > self.kept:
            self.after_space, self.older = {}, self.after_space
        if len(self.first) > self.kept // 10:
            self.first.clear()
        known, first = self.after_space, self.first
        cut = [t.split(" ") for t in texts]
        heads = [c.pop(0) for c in cut]
        fresh = list({h for h in heads if h not in first})
        first.update(zip(fresh, self.encode_many(fresh), strict=True))
        found = [list(map(known.get, c)) for c in cut]
        new = {k: set(compress(cut[k], map(is_, parts, repeat(None)))) for k, parts in enumerate(found) if None in parts}
        odd = {k for k, words in new.items() if any(not c or c.isspace() for c in {w[:1] for w in words})}
        wanted = set().union(*(w for k, w in new.items() if k not in odd))
        again = [w for w in wanted if w in self.older]
        known.update((w, self.older[w]) for w in again)
        words = list(wanted.difference(again))
        known.update(zip(words, self.encode_many([" " + w for w in words]), strict=True))
        whole = sorted(odd)
        ids_of = dict(zip(whole, self.encode_many([texts[k] for k in whole]), strict=True))
        out = [ids_of[k] if k in odd else first[head] + b"".join(map(known.__getitem__, cut[k]) if k in new else found[k]) for k, head in enumerate(heads)]
        for of, names in ((known, words), (first, fresh)):
            for w in names:
                if len(w) > LONGEST:
                    del of[w]
        return out
