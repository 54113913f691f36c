"""The training-data operators against plain versions, on small tables with every odd row."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, common, components, embedding_join, fm_index, html_text, minhash, packing, quality, substring, token_count, toxicity, warc
from larkspur.llm.chunks import ChunkEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, kept string, score double, rep long"


def corpus():
    """Texts with copies, near copies, shared passages, junk, nulls, and extra columns whose names clash with inner ones."""
    r = random.Random(11)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(400)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    base, passage = some(160), some(70)
    texts = [None, "", "   \n\t ", "one", "two words", "Two Words", " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[r.randrange(160)] = r.choice(words)
        texts.append(" ".join(near))
    texts += ["\n".join([" ".join(some(30)), " ".join(passage), " ".join(some(40))]) for _ in range(6)]
    texts += ["spam egg " * 60, "x" * 30_000, "日本 語 😀  a  b\r\n\x1c " + "é" * 50, "<|endoftext|> mid <|endoftext|>", "line here\n" * 9, " ".join(passage)]
    texts += [" ".join(some(r.randint(40, 200))) for _ in range(20)]
    return [(i * 3 % 211, t, "en", "s", len(t or ""), "clash", i, "no", 0.5, -1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return {row[0]: row[1] or "" for row in corpus()}


def test_word_hashes_tell_patterned_words_apart():
    import pyarrow as pa

    a, b = "a", "b"
    for _ in range(12):  # words on which hashes by powers of one base agree
        a, b = a + b, b + a
    column = [a, b, a[:1024], b[:1024], "ab" * 32, "ba" * 32, "x" * 64, "x" * 65, "x" * 128]
    (part,) = common.slices(pa.array(column))
    assert len(set(common.Words(part).hashes.tolist())) == len(column)
    (both,) = common.slices(pa.array([a.upper(), a]))
    assert len(set(common.Words(both, lower=True).hashes.tolist())) == 1


def test_word_hashes_find_the_words():
    import pyarrow as pa

    column = [row[1] for row in corpus()]
    seen = {}
    for part in common.slices(pa.array(column), 500):
        words = common.Words(part)
        for k in range(len(part)):
            own = WORD.findall(column[part.first + k] or "")
            h = words.hashes[words.offsets[k] : words.offsets[k + 1]].tolist()
            assert len(h) == len(own)
            for w, x in zip(own, h, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts().items()}
    rows = packing.pack_documents(docs, path).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sum((p for _, p in sorted(v)), []) for k, v in parts.items()} == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(empty, path).collect() == []


def test_packing_splits_by_ids(spark, monkeypatch):
    """Partitions of equally many ids: very long texts, and copies that lie at one place of the curve."""
    monkeypatch.setattr(packing, "PARTITION_IDS", 3000)
    monkeypatch.setattr(packing, "SAMPLE_IDS", 64)
    r = random.Random(7)
    rows = [(k, " ".join(r.choice(["oak", "elm", "fir", "yew", "ash"]) + str(r.randrange(500)) for _ in range(r.choice([5, 30, 200])))) for k in range(150)]
    rows += [(200 + k, "the same copy again and again " * 5) for k in range(300)] + [(900, "long text " * 4000), (None, "x"), (None, "x"), (200, "the same copy again and again " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    assert Counter(x["doc_id"] for x in got if x["start"] == 0) == Counter(k for k, _ in rows)
    size, used = Counter(), Counter()
    for x in got:
        size[x["sequence_id"] >> 36] += x["length"]
        used[x["sequence_id"]] += x["length"]
    assert sum(size.values()) == sum(x["doc_tokens"] for x in got if x["start"] == 0)
    assert len(size) > 8 and sorted(size.values())[-2] < 7000
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_hilbert_neighbours_touch():
    points = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_token_counts(docs, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = token_count.count_tokens(docs, model).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(library.encode(t)) for k, t in texts().items()}
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {k: len(t.encode()) for k, t in texts().items()}
    assert {r["doc_id"] for r in rows if r["over_limit"]} == {k for k, t in texts().items() if len(library.encode(t)) > 4096}
    assert token_count.count_tokens(empty, model).collect() == []
    assert Counter(x["doc_id"] for x in token_count.count_tokens(docs.union(docs).withColumn("n_tokens", F.lit("x")), model).collect()) == {k: 2 for k in texts()}
    r = random.Random(5)
    odd = ["a", "the", "in", " ", "  ", "▁", "<s>", "<unk>", "日", "😀", "\x00", "ing", "\n", "<0x0A>", "é"]
    many = ["".join(r.choice(odd) for _ in range(r.randint(0, 50))) for _ in range(2000)] + [" " * k for k in range(70)] + ["ab" * k for k in range(60)]
    assert token_count.PieceCounter(model).count(many) == [len(x) for x in library.encode(many)]


def test_byte_bpe(docs, empty):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: library.encode_ordinary(t) for k, t in texts().items()}
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == texts()
    assert byte_bpe.encode(empty, path, pattern).collect() == []
    clash = byte_bpe.encode(docs.union(docs), path, pattern).withColumn("decoded", F.lit(1))
    back = byte_bpe.decode(clash, path, pattern)
    assert back.columns == ["doc_id", "ids", "decoded"] and Counter(x["doc_id"] for x in back.collect()) == {k: 2 for k in texts()}
    codec = byte_bpe.ByteBPE(ranks, pattern)
    r = random.Random(9)
    odd = ["a", "the", " ", "  ", "\n", "\t", "日本", "😀", "\x1c", "\x85", "\xa0", "'s", "12", "!!", "<|endoftext|>", "\r\n", "　"]
    many = ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    got = [np.frombuffer(p, "<u4").tolist() for p in ChunkEncoder(codec.encode_many).encode(many)]
    assert got == [library.encode_ordinary(t) for t in many]
    data = b"internationalisation of the thing" * 12
    last = codec.table_for(data)
    assert codec.table_for(data, codec.table_for(data[:100])) == last
    for start, end, put in ((50, 53, b"xyz12"), (0, 0, b"q"), (len(data), len(data), b"!!"), (10, 200, b"")):
        new, table = codec.edited(data, last, start, end, put)
        assert table == codec.table_for(new)


def test_byte_bpe_memory(spark, monkeypatch):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # what a codec keeps is bounded by bytes, in one text as in many
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 200_000, raising=False)
    codec = byte_bpe.ByteBPE(ranks, pattern)
    r = random.Random(3)
    words = ["".join(r.choice("abcdeghiklmnoprstu") for _ in range(r.randint(3, 60))) for _ in range(6000)]
    for many in (["  ".join(words)], words, words[::-1]):
        assert [np.frombuffer(p, "<u4").tolist() for p in codec.encode_many(many)] == [library.encode_ordinary(t) for t in many]
        assert sum(getsizeof(k) + getsizeof(v) for held in (codec.known, codec.older) for k, v in held.items()) <= 400_000
    chunks = ChunkEncoder(codec.encode_many, 50)
    for _ in range(3):
        for at in range(0, 600, 20):
            many = [" ".join(words[max(0, at - 30) : at + 20]), "", " x", "a\n b"]
            assert [np.frombuffer(p, "<u4").tolist() for p in chunks.encode(many)] == [library.encode_ordinary(t) for t in many]
    # ids are decoded in bounded runs of rows, without an encoder
    rows = [(k, None if k % 3 == 0 else library.encode_ordinary(words[k] * (k % 4) + "日本 😀")) for k in range(40)]
    want = [library.decode_bytes(ids or []) for _, ids in rows]
    both = byte_bpe.encode(spark.createDataFrame([(k, x.decode() if k % 5 else None) for k, x in enumerate(want)], "k long, t string"), path, pattern, "k", "t", decoded="d")
    assert both.columns == ["k", "ids", "d"]
    assert {x["k"]: (x["ids"], bytes(x["d"])) for x in both.collect()} == {k: (library.encode_ordinary(x.decode()), x) if k % 5 else ([], b"") for k, x in enumerate(want)}
    got = byte_bpe.decode(spark.createDataFrame(rows, "k long, ids array<int>"), path, pattern).collect()
    assert {x["k"]: bytes(x["decoded"]) for x in got} == dict(enumerate(want))
    tokens, ids = byte_bpe.TokenBytes(ranks), pa.array([x for _, x in rows], pa.list_(pa.int32()))
    cuts = list(byte_bpe.runs(np.array([len(x or []) for _, x in rows]), 50))
    assert len(cuts) > 3 and [x for at, end in cuts for x in tokens.decode(ids.slice(at, end - at)).to_pylist()] == want
    for wrong in ([1 << 20], [-1], [None]):
        with pytest.raises(ValueError):
            tokens.decode(pa.array([[1], wrong], pa.list_(pa.int32())))


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    links = [(5, 3), (3, 5), (3, 9), (9, 1), (7, 7), (20, 21), (None, 4)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == roots({i for x in real for i in x}, real)


def test_embedding_join(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    rows = [(int(i), v.tolist(), int(i % 2)) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] * (1 + i) + 0.02 * r.normal(size=16) * (1 + i)).tolist(), int(i % 5 % 2)) for i in range(60)]
    rows += [(200 + i, base[7].tolist(), 1) for i in range(9)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, base[7].tolist(), None), (304, [None, *base[7][1:].tolist()], 1), (305, [], 1), (306, [float("inf"), *base[7][1:].tolist()], 1), (307, base[7][:3].tolist(), 1), (308, [float(x) * 1e300 for x in base[7]], 1)]
    good = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}

    def cosine(a, b):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [(a, b) for a, (x, p) in good.items() for b, (y, q) in good.items() if a < b and p == q and len(x) == len(y) and cosine(x, y) >= 0.98]
    want, n = roots([x[0] for x in rows], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_vectors(df.withColumn("rep", F.lit("x"))).collect()}
    assert got == {i: (n[i], c, c == i) for i, c in want.items()}
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def plain_statistics(text):
    w, seen = WORD.findall(text), defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_embedding_join_repeated_rows(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(4, 8))
    rows = [(1, base[0].tolist(), 1), (1, base[0].tolist(), 1), (2, (base[0] * 1.01 + 0.01).tolist(), 1), (3, base[1].tolist(), 1), (None, base[1].tolist(), 1), (4, base[2].tolist(), 2), (4, base[3].tolist(), 2)]
    got = sorted(tuple(x) for x in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect() if x["vec_id"] is not None)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 0, 4, True), (4, 0, 4, True)]


def test_embedding_join_wide_vectors(spark):
    r = np.random.default_rng(9)
    a = r.normal(size=20_000)
    rows = [(1, a.tolist(), 1), (2, (a + 0.05 * r.normal(size=20_000)).tolist(), 1), (3, (a + 0.5 * r.normal(size=20_000)).tolist(), 1), (4, a.tolist(), 2)]
    got = sorted(tuple(x) for x in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_quality(spark, docs, empty):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    labels = spark.createDataFrame([(row[0], 1) for row in corpus()] + [(999, 0), (None, 1), (0, None)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    rows = docs.select("doc_id", quality.verdict(F.col("text"), rules).alias("v")).select("doc_id", "v.*").collect()
    for row in rows:
        want = plain_statistics(texts()[row["doc_id"]])
        assert tuple(row[f] for f in fields) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert row["kept"] == (not row["base_failed"])
    assert quality.fit(empty, labels) == []


def plain_features(text):
    words, chars, symbols, dup, repeated = plain_statistics(text)
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    solid = "".join(w)
    return {"words": words, "mean_word": chars / max(words, 1), "symbols": symbols / max(words, 1), "dup_lines": dup / max(len(lines), 1), "repeated": repeated / max(words, 1), "bangs": solid.count("!") / max(words, 1), "capitals": sum("A" <= c <= "Z" for c in solid) / max(len(solid), 1), "distinct": len(set(w)) / max(words, 1)}


def plain_rule(rules, text):
    x = plain_features(text)
    return next((k for k, rule in enumerate(rules, 1) if all(x[t.feature] >= t.threshold if t.above else x[t.feature] <= t.threshold for t in rule)), 0)


def quality_corpus():
    """Good and bad documents, told apart by symbols; the bad ones are a quarter."""
    r = random.Random(31)
    rows = []
    for k in range(400):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(25, 60))]
        if k % 4 == 0:
            words = [w + r.choice(["#", "##", "$&"]) if r.random() < 0.6 else w for w in words]
        rows.append((k, " ".join(words), int(k % 4 != 0)))
    return rows


def test_quality_rules_reject(spark):
    term, rows = quality.Term, quality_corpus()
    texts_of = [t for _, t, _ in rows] + ["a b# " * 20, "ab# cd " * 20, None, ""]
    on_threshold = plain_features(texts_of[0])["symbols"]
    rules = [[term("symbols", True, on_threshold)], [term("mean_word", False, 4.0), term("words", True, 30.0)], [term("capitals", True, 0.5)]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts_of)], "doc_id long, text string")
    got = {x["doc_id"]: x["v"] for x in df.select("doc_id", quality.verdict(F.col("text"), rules).alias("v")).collect()}
    found = set()
    for k, t in enumerate(texts_of):
        want = plain_rule(rules, t or "")
        found.add(want)
        assert got[k]["rule"] == want and got[k]["kept"] == (want == 0 and not got[k]["base_failed"])
    assert found == {0, 1, 2} and got[0]["rule"] == 1


def test_quality_learns_from_labels(spark):
    rows = quality_corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, kept string")
    labels = [(k, y) for k, _, y in rows if k % 5]
    labels += [(labels[0][0], 1), (labels[1][0], None), (None, 0), (7777, 0)]  # a label of two values counts as the lower one
    rules = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and rules[0][0].feature == "symbols"
    unseen = {k: y for k, _, y in rows if k % 5 == 0}
    got = {x["doc_id"]: x["v"]["kept"] for x in docs.select("doc_id", quality.verdict(F.col("text"), rules).alias("v")).collect()}
    assert np.mean([got[k] == bool(y) for k, y in unseen.items()]) > 0.95
    twice = docs.union(docs)
    assert quality.fit(twice, spark.createDataFrame(labels, "doc_id long, quality int"))[0][0].feature == "symbols"


def test_decision_list_learns_a_conjunction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5)
    rules = quality.learn_rules(x, bad, np.arange(3000) % 3 == 0, ["a", "b", "c"])
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= quality.covered(rule, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97


def test_fm_index_finds_the_windows():
    r = random.Random(3)
    for _ in range(40):
        size, letters = r.choice([2, 3, 5]), r.choice([2, 3, 10])
        rows = [[r.randrange(letters) for _ in range(r.randint(0, 15))] for _ in range(r.randint(1, 12))]
        owners = np.array([r.randrange(6) for _ in rows])
        index = fm_index.FMIndex(np.array([x for s in rows for x in s], dtype=np.uint64), np.array([len(s) for s in rows], dtype=np.int64), owners)
        for q, found in enumerate(index.matches(owners, size)):
            starts = lambda s: range(len(s) - size + 1)
            earlier = {tuple(s[j : j + size]) for k, s in enumerate(rows) if owners[k] < owners[q] for j in starts(s)}
            assert {i for a, b in found for i in range(a, b)} == {i for i in starts(rows[q]) if tuple(rows[q][i : i + size]) in earlier}


def test_substring(docs, empty):
    seen, want = {}, {}
    for k, t in sorted(texts().items()):
        w, cut = WORD.findall(t), set()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), k) < k:
                cut.update(range(i, i + 50))
        want[k] = (len(w), len(cut), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in cut).encode()).hexdigest())
    rows = substring.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    for r in rows:
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert sum(n for _, n, _ in want.values()) > 300
    assert substring.remove_repeats(empty).collect() == []


def plain_repeats(by_id):
    """(n_words, n_removed, kept_sha256) of each text by every window."""
    seen, want = {}, {}
    for k, t in sorted(by_id.items()):
        w, cut = WORD.findall(t), set()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), k) < k:
                cut.update(range(i, i + 50))
        want[k] = (len(w), len(cut), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in cut).encode()).hexdigest())
    return want


def test_substring_repeats_inside_one_document(spark):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    own, late, part = fresh(150), fresh(120), fresh(90)
    rows = {
        1: fresh(30) + own + fresh(40) + own + fresh(20) + own,  # the smallest holder repeats it
        2: fresh(25) + own + fresh(35) + late + fresh(60) + late + part,
        3: own + fresh(20) + own + late + fresh(10) + late + part[:70] + fresh(9) + part + fresh(5) + part[10:],
        4: fresh(70) + part[20:] + fresh(80) + part[20:] + fresh(3) + own[40:] + own[40:],
    }
    texts_of = {k: " ".join(w) for k, w in rows.items()}
    want = plain_repeats(texts_of)
    assert want[1][1] == 0 and want[2][1] == 150
    got = substring.remove_repeats(spark.createDataFrame(sorted(texts_of.items()), "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == want


def test_substring_repeated_rows(spark):
    r = random.Random(12)
    fresh = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    shared, twin = fresh(60), fresh(90)
    first, second = f"{fresh(9)} {shared} {fresh(9)} {shared}", f"{fresh(30)} {shared} {twin}"
    rows = [(1, first), (1, first), (2, second), (2, second), (2, f"{twin} {fresh(10)}"), (2, second + "  "), (3, twin), (3, twin), (None, first), (4, None), (4, None)]
    want, seen = [], {}
    for k, t in sorted(rows, key=lambda x: x[0] or 0):
        w, cut = WORD.findall(t or ""), set()
        for i in range(len(w) - 49):
            if k is not None and seen.setdefault(tuple(w[i : i + 50]), k) < k:
                cut.update(range(i, i + 50))
        want.append((k, len(w), len(cut), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in cut).encode()).hexdigest()))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got), key=str) == sorted(want, key=str)


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1200):
        bad = k % 6 == 0
        text = [r.choice(words) for _ in range(60)] + (["Vile", "creature"] * 2 if bad else [])
        r.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([*labels, (5000, None), (3, 0)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(got) == 1203 and all(0 <= s <= 1 for s in got.values())
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= toxicity.THRESHOLD) == y for k, y in held]) > 0.97
    assert len(model[0]) < 200
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


def plain_ftrl(rows):
    """FTRL-proximal with dictionaries, coordinate by coordinate."""
    count = Counter(f for _, fs in rows for f in fs.tolist())
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        free = 0.0 if f == "bias" else toxicity.L1
        if abs(z[f]) <= free:
            return 0.0
        return (math.copysign(free, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            y, fs = rows[k]
            active = [f for f in fs.tolist() if count[f] >= toxicity.LEAST_ROWS] + ["bias"]
            w = {f: weight(f) for f in active}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in active:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: weight(f) for f in [*count, "bias"] if weight(f)}


def test_learner_equals_plain_ftrl():
    r = np.random.default_rng(3)
    rows = []
    for k in range(300):
        f = np.unique(r.integers(0, 400, 30))
        y = int(k % 5 == 0)
        rows.append((y, (np.unique(np.r_[f, 1000, 1001]) if y else f).astype(np.int32)))
    buckets, weights, bias = toxicity.learn(rows)
    want = plain_ftrl(rows)
    assert abs(want.pop("bias") - bias) < 1e-9
    assert dict(zip(buckets.tolist(), weights.tolist(), strict=True)) == pytest.approx(want)
    assert {1000, 1001} <= set(buckets.tolist())


def test_toxicity_features():
    import pyarrow as pa

    column = ["One two  two three ONE two", "", None, "a b", "x" * 100 + " y"]
    (part,) = common.slices(pa.array(column))
    owner, _ = toxicity.features(part)
    for k, text in enumerate(column):
        w = WORD.findall((text or "").translate(LOWER))
        assert (owner == k).sum() == len(set(w)) + len(set(zip(w, w[1:], strict=False))) + len(set(zip(w, w[2:], strict=False)))


def test_toxicity_repeated_rows_and_clashing_columns(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["sun", "rain", "wind", "snow", "hail"]) for _ in range(20)) + (" vile brute" if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows] + [(1, None)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(once, labels)
    again = toxicity.train(once.union(once).union(once.where("doc_id < 50")), labels)
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True))
    clash = once.limit(5).withColumn("score", F.lit("old")).withColumn("k", F.lit(1)).withColumn("_y", F.lit(2))
    got = toxicity.with_score(clash.union(clash), model)
    assert sorted(got.columns) == ["_y", "doc_id", "k", "score", "text"] and got.schema["score"].dataType.simpleString() == "double"
    assert len({(x["doc_id"], x["score"]) for x in got.collect()}) == 5 and got.count() == 10
    long = spark.createDataFrame([(1, "vile brute " * 300_000)], "doc_id long, text string")
    assert toxicity.score(long, model).first()["score"] > 0.5


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash(docs, empty):
    sets = {k: shingles(t) for k, t in texts().items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {k: (len(sets[k]), c, c == k) for k, c in want.items()}
    assert len(links) > 20
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_repeated_rows(spark):
    r = random.Random(6)
    words = [f"t{r.randrange(10**9)}" for _ in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-2], "x", "y"]), " ".join(f"u{r.randrange(10**9)}" for _ in range(60))
    rows = [(5, text), (5, text), (7, near), (7, near), (8, other), (9, other), (9, other), (None, text), (3, None), (3, None)]
    got = sorted((tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 56, 5, True)] * 2 + [(7, 56, 5, False)] * 2 + [(8, 56, 8, True)] + [(9, 56, 8, False)] * 2 + [(None, 56, 5, True)] + [(3, 0, 3, True)] * 2, key=str)


def test_minhash_pages_of_one_form(spark):
    """A hot bucket of documents that share most words but are no near-duplicates, and a few that are."""
    r = random.Random(16)
    form = [f"f{k}" for k in range(140)]
    fill = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    texts_of = {k: form + fill(50) for k in range(150)}
    for k in range(0, 30, 3):
        texts_of[200 + k] = texts_of[k][:-6] + fill(6)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts_of.items()], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df).collect()}
    sets = {k: shingles(" ".join(w)) for k, w in texts_of.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == roots(sets, links) and len(links) == 10


def test_warc(spark, tmp_path):
    body = "<p>" + "long payload " * 20
    rows = [(4, "http://a", body), (2, "http://b", body), (9, None, body), (1, "u", "short"), (3, "u", "short"), (5, "u\r\nx", None), (6, "u", ""), (None, "u", body + "!"), (7, "u", "\x1f\x8b\x08 WARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.write_archives(df, f"file://{tmp_path}/w")
    for size in (1 << 22, 300, 64):
        got = {r["record_id"]: r for r in warc.read_warc(spark, folder, size).collect()}
        assert len(got) == len(rows)
        assert {k: r["refers_to"] for k, r in got.items() if r["refers_to"]} == {"4": "2", "9": "2"}
        assert bytes(got["2"]["payload"]).decode() == body and bytes(got["9"]["payload"]) == b""
        assert all(got[str(k)]["payload_bytes"] == len((h or "").encode()) for k, _, h in rows if k is not None)
    none = warc.write_archives(df.where("false"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, none).collect() == []


def test_warc_long_payloads(spark, tmp_path):
    r = random.Random(3)
    body = "".join(chr(r.randrange(33, 9000)) for _ in range(1_500_000))
    rows = [(1, "u", body), (2, "u", body), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", "y" * 100), (6, "u", "y" * 100)]
    folder = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = {int(x["record_id"]): x for x in warc.read_warc(spark, folder, 1 << 18).collect()}
    assert {k: x["refers_to"] for k, x in got.items()} == {1: None, 2: "1", 3: None, 4: None, 5: None, 6: "5"}
    assert bytes(got[1]["payload"]).decode() == body and got[2]["payload_bytes"] == len(body.encode())


def test_warc_passes_over_what_other_attempts_left(spark, tmp_path):
    rows = [(k, "u", f"page {k} " * 40) for k in range(50)] + [(7, "u", "page 7 " * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_key", F.lit(0)).repartition(3)
    folder = warc.write_archives(df, f"file://{tmp_path}/w")
    written = sorted((tmp_path / "w").glob("part-*.warc.gz"))
    (tmp_path / "w" / "part-00000-00001-99.warc.gz").write_bytes(written[0].read_bytes())
    (tmp_path / "w" / "other.warc.gz").write_bytes(written[0].read_bytes()[:100])
    got = sorted(int(r["record_id"]) for r in warc.read_warc(spark, folder).collect())
    assert got == sorted(r[0] for r in rows)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc.gz").write_bytes(b"".join(p.read_bytes() for p in written))
    assert sorted(int(r["record_id"]) for r in warc.read_warc(spark, f"file://{tmp_path}/plain", 500).collect()) == got


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body><nav><a href=/>menu {k}</a></nav>
<div class="ad">buy {k}</div><aside>side</aside><article><h1>Head {k}</h1><p class=teaser>Read with us</p><p><b>One &amp; two<br>three {k}<p>Fou<i>r</i>   five&nbsp;six {k}
<form>mail</form><ul><li>a {k}<li>b {k}</ul><div id="comments"><p>hater {k}</p></div></article><footer>&copy; {k}</footer></body>"""


def test_html(spark):
    rows = [(k, f"http://H.example/{k}", PAGE.format(k=k)) for k in range(12)] + [(100, None, None), (101, "bad url", ""), (102, "http://x/", "plain <b>text</b> only"), (103, "http://y/", "<div><div class=menu>m</div><div><p>Long text here, really long text.</p><p>More of the same text.</p></div></div>"), (104, "http://y/2", "<p>a<<b>&#x41;&am</p><!-- x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[3] == "Head 3\n\nOne & two three 3\n\nFour five six 3\n\na 3\n\nb 3"
    assert got[100] == got[101] == ""
    assert got[102] == "plain text only"
    assert got[103] == "Long text here, really long text.\n\nMore of the same text."
    assert got[104].startswith("a<") and "A" in got[104]
    assert html_text.main_text(df.where("false")).collect() == []


def plain_wrapper(sources):
    """A host's wrapper by plain counting over its pages, all in one place."""
    pages = [html_text.parse(x) for x in sources]
    shapes = [html_text.shape_of(p) for p in pages]
    n = Counter(shape for shape, _ in shapes)
    tree = html_text.merged(list(n.items()))
    root = html_text.read(tree)
    slots = {shape: html_text.aligned(root, html_text.read(shape)) for shape in n}
    having, pages_of, chars, links = Counter(), Counter(), Counter(), Counter()
    for page, (shape, numbers) in zip(pages, shapes, strict=True):
        having.update(set(slots[shape]) - {-1})
        keys = [(slots[shape][numbers[b]], html_text.text_hash(t)) for b, t, _ in page.texts]
        pages_of.update(k for k in set(keys) if k[0] >= 0)
        for k, (_, t, link) in zip(keys, page.texts, strict=True):
            chars[k] += len(t)
            links[k] += link
    constants = {k for k, c in pages_of.items() if c >= html_text.SHARE * max(having[k[0]], html_text.LEAST_PAGES)}
    stats = {slot: [0, 0, 0] for slot, _ in pages_of}
    for k, c in pages_of.items():
        own = stats[k[0]]
        own[0] += c
        if k not in constants:
            own[1] += chars[k]
            own[2] += links[k]
    return html_text.Wrapper(tree, [(slot, *own) for slot, own in stats.items()], constants)


def site(r, n, named=True):
    """n pages of a host: menu, constant line, advert, article of varying paragraphs with a constant one among them, footer."""
    words = lambda k: " ".join(r.choice(["sea", "hill", "corn", "bell", "lamp", "tide", "moss"]) + str(r.randrange(99)) for _ in range(k))
    pages = []
    for k in range(n):
        own = [words(r.randint(8, 60)) for _ in range(r.randint(9, 14))]
        lines = [f"<p>{x}</p>" for x in own]
        lines.insert(r.randrange(len(lines)), "<p>Printed with the kind leave of the owner</p>")
        title = words(4)
        body = f"<h1>{title}</h1>" + "".join(lines) + "<ul>" + "".join(f"<li><a href=/>{words(3)}</a></li>" for _ in range(5)) + "</ul>"
        menu = "<ul>" + "".join(f"<li><a href=/>{words(1)}</a></li>" for _ in range(6)) + "</ul>"
        tags = ("nav", 'div class="ad"', "article", "footer") if named else ("div",) * 4
        shut = [t.split()[0] for t in tags]
        parts = (menu, words(6), body, f"From {words(5)}")
        pages.append(("<body>" + "".join(f"<{t}>{x}</{c}>" for t, x, c in zip(tags, parts, shut, strict=True)), "\n\n".join([title, *own])))
    return pages


@pytest.mark.parametrize("named", [True, False])
def test_wrapper_finds_the_article(named):
    pages = site(random.Random(8), 30, named)
    wrapper = plain_wrapper([p for p, _ in pages])
    assert [html_text.extract(p, wrapper) for p, _ in pages] == [want for _, want in pages]


@pytest.mark.parametrize("group", [2000, 3])
def test_wrapper_equals_a_plain_one(spark, monkeypatch, group):
    monkeypatch.setattr(html_text, "MERGED", group)
    r = random.Random(21)
    hosts = {"a.example": site(r, 25), "b.example": site(r, 40, False), "c.example": site(r, 3)}
    hosts["d.example"] = [("<div>" * r.randint(1, 40) + f"<p>{r.random()}</p><div class=x{k}>tail</div>", None) for k in range(30)]
    rows = [(k, f"https://{h}/{k}", p) for h, pages in hosts.items() for k, (p, _) in enumerate(pages)]
    rows += rows[:5]
    want = []
    for h, pages in hosts.items():
        sources = [x[2] for x in rows if h in x[1]]
        wrapper = plain_wrapper(sources) if len(sources) >= html_text.LEAST_PAGES else None
        want += [(x[0], x[1], html_text.extract(x[2], wrapper)) for x in rows if h in x[1]]
    for parts in (1, 7):  # the layout of the table makes no difference
        if group == 3 and parts == 1:
            continue
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert sorted(tuple(x) for x in html_text.main_text(df).collect()) == sorted(want)


def test_long_pages():
    lines = [f"Line {k} of a very long page" for k in range(60_000)]
    pages = [f"<body><div><a href=x>menu {k}</a></div><div><h1>Page {k}</h1>{''.join(f'<p>{x} {k}</p>' for x in (lines if k == 3 else lines[:9]))}</div></body>" for k in range(9)]
    wrapper = plain_wrapper(pages)
    assert html_text.extract(pages[3], wrapper) == "\n\n".join(["Page 3", *(f"{x} 3" for x in lines)])


def test_page_unlike_its_host_keeps_its_text():
    wrapper = plain_wrapper([p for p, _ in site(random.Random(8), 30)])
    other = "<table><tr><td><div><p>One line</p></div></td><td><div><p>Another line</p></div></td></tr></table><div class=comments>no</div>"
    assert html_text.extract(other, wrapper) == "One line\n\nAnother line"


def test_pages_of_any_depth_and_width():
    deep = ["<div>" * 100_000 + "text", "<b>" * 100_000 + "<p>text", "<ul><li>" * 50_000 + "text", "<table><tr><td>" * 20_000 + "text"]
    for source in deep:
        page = html_text.parse(source)
        wrapper = html_text.wrapper_of(html_text.merged([(html_text.shape_of(page)[0], 9)]), None, None)
        assert wrapper.extract(page) == html_text.by_names(page) == "text"
    wide = html_text.shape_of(html_text.parse("<p>a</p><div>b</div>" * 2000))[0]
    other = html_text.shape_of(html_text.parse("<div>c</div><p>d</p>" * 1800))[0]
    began = time.time()
    html_text.merged([(wide, 5), (other, 4)])
    assert time.time() - began < 5


def plain_match(a, b):
    """The pairs of two child lists that match most nodes, of several the earliest, by the plain table."""
    if [x.label for x in a] == [y.label for y in b]:
        return sum(1 + plain_match(x.kids, y.kids)[0] for x, y in zip(a, b, strict=True)), [(k, k) for k in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            w = best[i][j] + 1 + plain_match(x.kids, y.kids)[0] if x.label == y.label else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], w)
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return best[-1][-1], out[::-1]


@pytest.mark.parametrize("cells", [0, 300])
def test_long_lists_match_most_nodes(monkeypatch, cells):
    monkeypatch.setattr(html_text, "CELLS", cells, raising=False)
    r = random.Random(12)
    tree = lambda d: r.choice("abc") + (f"({','.join(tree(d - 1) for _ in range(r.randint(1, 4)))})" if d and r.random() < 0.6 else "")
    for n, m in [(1, 1), (2, 5), (9, 4), (30, 31), (60, 20), (230, 210), (3, 15000), (15000, 3)]:
        a, b = (html_text.read(f"r({','.join(tree(2 if k < 1000 else 0) for _ in range(k))})").kids for k in (n, m))
        assert html_text.match_kids(a, b) == plain_match(a, b)[1]
    # a partner far off is one still, and a text in it is counted there
    head, tail = "".join(f"<div class={x}{y}>t</div>" for x in "abcdefghijklmnop" for y in "abcdefghijklmnop"), "<dl><dt>Old line</dt></dl>"
    pages = [f"<body><div>{head if k % 2 else ''}{tail}<p>{f"own text of page {k} " * 60}</p></div></body>" for k in range(20)]
    shapes = [html_text.shape_of(html_text.parse(x))[0] for x in pages[:2]]
    root = html_text.read(html_text.merged([(shapes[1], 10), (shapes[0], 10)]))
    assert [x.pages for x in html_text.all_slots(root) if x.label in ("dl", "dt", "p")] == [20, 20, 20]
    wrapper = plain_wrapper(pages)
    assert "Old line" not in html_text.extract(pages[4], wrapper) + html_text.extract(pages[5], wrapper)


def test_long_lists_of_few_differences_are_matched_in_bounded_time(monkeypatch):
    r = random.Random(13)
    pieces = ["p", "div", "p(b)", "div(p,ul(li))", "ul(li)", "div(p,p,ul)", "table"]

    def changed(kids, n):
        kids = list(kids)
        for _ in range(n):
            k = r.randrange(len(kids) + 1)
            kids[k : k + r.randint(0, 3)] = [r.choice(pieces) for _ in range(r.randint(0, 3))]
        return kids

    for off in (1, 2, 64):
        monkeypatch.setattr(html_text, "OFF", off, raising=False)
        monkeypatch.setattr(html_text, "CELLS", 0)
        for n, m in ((1, 1), (40, 1), (40, 5), (60, 30), (30, 300)):
            a = [r.choice(pieces) for _ in range(n)]
            b = changed(a, m)
            one, other = (html_text.read(f"r({','.join(x)})").kids if x else [] for x in (a, b))
            assert html_text.match_kids(one, other) == plain_match(one, other)[1]
            assert html_text.match_kids(other, one) == plain_match(other, one)[1]
    a = [r.choice(pieces) for _ in range(60_000)]
    one, other = (html_text.read(f"r({','.join(x)})").kids for x in (a, changed(["table", *a[1:]], 40)))
    began = time.time()
    assert len(html_text.match_kids(one, other)) > 59_000
    assert time.time() - began < 20


def test_wrapper_keeps_the_common_slots(monkeypatch):
    monkeypatch.setattr(html_text, "SLOTS", 12)
    pages = [f"<body><div class=x><p>Old line</p><h2>own text of page {k} and more</h2></div>" + "".join(f"<div class={'abcdefgh'[k % 8]}{'ijklmnop'[j]}>t</div>" for j in range(8)) for k in range(40)]
    wrapper = plain_wrapper(pages)
    assert wrapper.root.size <= 12 and wrapper.pages == 40
    assert "Old line" not in html_text.extract(pages[33], wrapper)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert json.dumps(sorted(names))
