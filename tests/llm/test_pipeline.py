"""The corpus pipeline against the plain operators, stage by stage."""

import math
import random
import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import plain_rule, plain_statistics

from larkspur.llm import quality, toxicity
from larkspur.llm.common import held, slices

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    before = {r["doc_id"]: r for r in docs.collect()}
    counts = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        rows = docs.collect()
        counts.append(len(rows))
        for r in rows:
            if r["text"] == before[r["doc_id"]]["text"]:
                assert r["n_chars"] == before[r["doc_id"]]["n_chars"]
            else:
                assert name == "repeated passages"
    assert counts == sorted(counts, reverse=True) and counts[-1] > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == counts[-1] and all(r["n"] == r["t"] for r in pieces)


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()


def test_near_duplicates_keep_null_ids(spark):
    text = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"term{k}" for k in range(80))
    rows = [(1, text), (2, text), (3, other), (None, text), (None, "a few other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, text), (3, other), (None, text), (None, "a few other words"), (None, None)], key=str)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs):
    return sorted((tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def plain_near_duplicates(rows):
    """Rows without those of a smaller id's group, by comparing every two sets."""

    def shingles(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = {}, {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]], up[r[0]] = shingles(r[1]), r[0]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((r for r in rows if r[0] is None or find(r[0]) == r[0]), key=str)


def plain_passages(rows):
    """Rows without the words of windows that start in a smaller id, and without rows that lose all words."""
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, cut = WORD.findall(r[1] or ""), set()
        for i in range(len(w) - 49):
            if r[0] is not None and seen.setdefault(tuple(w[i : i + 50]), r[0]) < r[0]:
                cut.update(range(i, i + 50))
        if cut:
            text = " ".join(x for i, x in enumerate(w) if i not in cut)
            if text:
                out.append((r[0], text, r[2], r[3], len(text)))
        else:
            out.append(r)
    return sorted(out, key=str)


def planted(r):
    """Documents with exact and near copies, shared passages, null ids and texts, and rows that repeat an id."""
    words = lambda n: " ".join(f"w{r.randrange(10**7)}" for _ in range(n))
    base, passage = words(90), words(70)
    texts = [(k, words(r.randint(30, 120))) for k in range(10)]
    texts += [(20, base), (21, base), (22, base.upper()), (23, base.rsplit(" ", 4)[0] + " " + words(4)), (24, base.split(" ", 5)[5] + " " + words(5))]
    texts += [(30 + k, f"{words(40)} {passage} {words(30)}") for k in range(4)] + [(40, passage + " " + words(3)), (41, passage)]
    texts += [(None, base), (None, None), (50, None), (51, ""), (52, "few words"), (53, "few words"), (54, words(60)), (54, words(61))]
    return [(k, t, "en", "s", len(t or "")) for k, t in texts]


def test_stages_equal_plain_ones(spark):
    rows = planted(random.Random(23))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind).repartition(3)
    left = rows_of(corpus_pipeline.near_duplicate_stage(spark, docs.withColumn("rep", F.lit(1)), SF))
    assert left == plain_near_duplicates(sorted(rows, key=str)) and 3 < len(rows) - len(left) < 10
    kept = rows_of(corpus_pipeline.repeated_passage_stage(spark, docs.withColumn("id", F.lit(1)), SF))
    assert kept == plain_passages(rows) and len(kept) < len(rows)


def test_learned_stages_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    rows += [(None, "a word", "en", "s", 6), (7, None, "en", "s", 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    buckets, weights, bias = toxicity.train(docs, labels)
    weight = dict(zip(buckets.tolist(), weights.tolist(), strict=True))

    def score(text):
        (part,) = slices(pa.array([text], pa.string()))
        return 1 / (1 + math.exp(-bias - sum(weight.get(f, 0.0) for f in toxicity.features(part)[1].tolist())))

    want = sorted((r for r in rows if score(r[1]) < toxicity.THRESHOLD), key=str)
    assert rows_of(corpus_pipeline.toxicity_stage(spark, docs, SF)) == want
    rules = quality.fit(docs, labels)
    want = sorted((r for r in rows if not plain_base_failed(r[1] or "") and plain_rule(rules, r[1] or "") == 0), key=str)
    got = rows_of(corpus_pipeline.quality_stage(spark, docs, SF))
    assert got == want and len(got) < len(rows)


def plain_base_failed(text):
    words, _, _, _, repeated = plain_statistics(text)
    return words < quality.LEAST_WORDS or 100 * repeated > quality.MOST_REPEATED * words


def test_run_equals_its_stages(spark):
    before = held()
    got = corpus_pipeline.run(spark, SF)
    assert len(held() - before) <= 2  # the last stage's input, and the ids that it packs
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
