"""Operators and expressions on small literal tables."""

import collections
import math
import random
import re
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur import semantics as S
from larkspur.functions import bits, geometry, networks, ranges, temporal, user
from larkspur.operators import dml, ordered
from larkspur.operators import relational as R
from larkspur.operators.policies import Policies
from larkspur.plans import catalog
from larkspur.sources import files
from larkspur.stats import profile
from larkspur.streaming import windows
from larkspur.text import search
from larkspur.text.stem import porter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_numbers(spark):
    assert one(spark, S.int_div(F.lit(-7), F.lit(2))) == -3
    assert one(spark, S.int_div(F.lit(7), F.lit(0))) is None
    assert one(spark, S.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.trunc_number(F.lit(-1.567), 1)) == -1.5
    assert one(spark, S.trunc_number(F.lit(1567.0), -2)) == 1500.0


def test_strings(spark):
    s = F.lit("hello")
    assert one(spark, S.substr_clamped(s, 0, 2)) == "he"
    assert one(spark, S.left_part(s, -2)) == "hel"
    assert one(spark, S.right_part(s, -2)) == "llo"
    assert one(spark, S.regexp_replace_first(s, "l", "L")) == "heLlo"
    assert one(spark, S.regexp_replace_first(s, "(e)(l)", r"\2\1")) == "hlelo"
    assert one(spark, S.similar_to(s, "h(e|a)%")) is True
    assert one(spark, S.trim_white(F.lit("\t a b\n"))) == "a b"


def test_joins_with_nulls(spark):
    left = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    assert values(R.not_in(left, "k", spark.createDataFrame([(1,), (None,)], "j int"), "j")) == []
    assert values(R.not_in(left, "k", spark.createDataFrame([(1,)], "j int"), "j")) == [(3,)]
    assert len(values(R.not_in(left, "k", spark.createDataFrame([], "j int"), "j"))) == 3


def test_ties_and_first_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 3)], "id int, v int")
    assert values(R.limit_with_ties(df, 1, [F.desc("v")], ["v"])) == [(1, 5), (2, 5)]
    assert values(R.distinct_on(df, ["v"], [F.desc("id")])) == [(2, 5), (3, 4), (4, 3)]


def test_groups_frame(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("a", 9)], "g string, v int")
    got = R.groups_frame(df, ["g"], "v", 1, 0, n=lambda: F.count("*"))
    assert sorted(r["n"] for r in got.collect()) == [2, 2, 2, 3]


def test_recursion_reaches_a_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "a int, b int")
    got = R.recursive_distinct(spark.createDataFrame([(1,)], "n int"), lambda new: new.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")))
    assert values(got) == [(1,), (2,), (3,)]


def test_project_set_pads(spark):
    got = R.project_set(spark.range(1), a=F.array(F.lit(1), F.lit(2), F.lit(3)), b=F.array(F.lit(9)))
    assert values(got) == [(0, 1, 9), (0, 2, None), (0, 3, None)]


def test_types(spark):
    assert one(spark, ranges.contains(ranges.parse("[1,)"), F.lit(1)))
    assert not one(spark, ranges.contains(ranges.parse("(1,1)"), F.lit(1)))
    assert one(spark, networks.ipv4(F.lit("256.1.1.1"))) is None
    assert one(spark, networks.ipv6_text(F.lit("0:0:0:0:0:0:0:1"))) == "::1"
    assert one(spark, networks.mac(F.lit("08002B-010203"))) == "08:00:2b:01:02:03"
    assert one(spark, bits.both(F.lit("110"), F.lit("011"))) == "010"
    assert one(spark, bits.either(F.lit("110"), F.lit("011"))) == "111"
    assert one(spark, bits.inverted(F.lit("110"))) == "001"
    assert one(spark, geometry.path_length(F.array(geometry.point(F.lit(0), F.lit(0))))) == 0.0
    assert one(spark, user.enum_ordinal(F.lit("c"), ["a", "b"])) is None


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("revival", "reviv"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("sky", "sky")])
def test_stems(word, stem):
    assert porter(word) == stem


def test_search(spark):
    docs = spark.createDataFrame([(1, "The cats are running fast"), (2, "A dog"), (3, ""), (4, None)], "id int, t string")
    vectors = search.to_tsvector(docs, "id", "t")
    query = search.Query.of_text("running cat")
    assert values(vectors.where(query.matches(F.col("vector"))).select("id")) == [(1,)]
    assert values(vectors.where(search.Query.parse("!cat & (dog | fish)").matches(F.col("vector"))).select("id")) == [(2,)]
    assert one(spark, search.ts_headline(F.lit("one two three four"), search.Query.parse("three"), 2)).count("<b>three</b>") == 1
    with pytest.raises(ValueError):
        search.Query.parse("a &")
    texts = [(k, t) for k, t in enumerate(["The cat", "the_cat", "CAT2 cats", "a-cat's", "scat cat", "", None, "Été cat", "xécat", "cat\nthe the"])]
    df = spark.createDataFrame(texts, "id int, t string")
    for text in ("cat", "!cat", "the & cat", "cats | !the"):
        query = search.Query.parse(text)
        vector = search.term_vector(F.col("t"), query.terms())
        assert values(df.where(query.matches_text(F.col("t"))).select("id")) == values(df.where(F.col("t").isNotNull() & query.matches(vector)).select("id"))
        assert values(df.where("t IS NOT NULL").select("id", search.text_rank(F.col("t"), query))) == values(df.where("t IS NOT NULL").select("id", search.ts_rank(vector, query)))


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "k int, v string")
    more = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "k int, v string")
    assert values(profile.dependencies(more, ["k", "v"])) == [("k", "v", 0.75), ("v", "k", 0.75)]
    assert values(profile.dependencies(df, ["k", "v"])) == [("k", "v", 1.0), ("v", "k", 1.0)]
    assert [r["n_distinct"] for r in profile.column_profile(df, ["k", "v"]).collect()] == [3, 2]


def test_constraints(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    assert files.check_rows(df, check="k > 0").count() == 2
    with pytest.raises(Exception, match="violates"):
        files.check_rows(df, ("k",)).collect()


def test_stream_equals_table(spark):
    sf = "/root/testdata/sf0.001"
    stream = windows.run_once(windows.hourly_counts(windows.event_stream(spark, sf)), "hourly")
    assert values(stream) == values(windows.hourly_counts(spark.read.parquet(f"{sf}/events.parquet")))


def test_dictionaries(spark):
    groups = [["car", "auto"], ["Auto", "bus"]]
    assert one(spark, search.thesaurus_lexemes(F.lit("AUTO"), groups)) == ["car", "auto"]
    assert one(spark, search.thesaurus_lexemes(F.lit("Bus"), groups)) == ["auto", "bus"]
    assert one(spark, search.thesaurus_lexemes(F.lit("Bike"), groups)) == ["bike"]
    affixes = [("ing", False), ("re", True)]
    for word, want in (("Studying", "study"), ("restudy", "study"), ("nothing", "nothing"), ("RE", "re"), ("Study", "study")):
        assert one(spark, search.affix_lexeme(F.lit(word), ["study", "turn"], affixes)) == want
    assert one(spark, search.simple_lexeme(F.lit("flies"))) == search.lexeme_of("flies", "simple") == "fly"


def ordered_table(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([None, *range(40)]), k) for k in range(400)] + [(None, 5, 400), (None, None, 401)]
    return rows, spark.createDataFrame(rows, "g string, v int, k int").repartition(5)


def test_running_totals_ranks_and_frames(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RUN", 16)
    rows, df = ordered_table(spark)
    w = Window.partitionBy("g").orderBy(F.col("k").asc_nulls_last())
    want = df.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    assert values(ordered.running_total(df, ["g"], ["k"], s=F.col("v"))) == values(want)
    by = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last())
    want = df.withColumn("rank", F.rank().over(by)).withColumn("dense_rank", F.dense_rank().over(by))
    assert values(ordered.ranks(df, ["g"], "v")) == values(want)
    frame = w.rowsBetween(-3, 2)
    want = df.withColumn("s", F.sum("v").over(frame)).withColumn("lo", F.min("v").over(frame))
    assert values(ordered.sliding_rows(df, ["g"], ["k"], 3, 2, s=F.sum("v"), lo=F.min("v"))) == values(want)
    assert ordered.running_total(df.where("false"), ["g"], ["k"], s=F.col("v")).collect() == []


def test_percentiles_mode_and_offset(spark):
    rows, df = ordered_table(spark)
    of = {g: sorted(v for h, v, _ in rows if h == g and v is not None) for g in ("a", "b", None)}
    got = {x["g"]: (x["d"], x["c"]) for x in ordered.percentiles(df, ["g"], "v", {"d": (0.3, False), "c": (0.5, True)}).collect()}
    assert got == {g: (v[max(math.ceil(0.3 * len(v)) - 1, 0)], statistics.median(v)) for g, v in of.items()}
    assert ordered.mode(df, [], "v").first()[0] == min(statistics.multimode(sorted(v for _, v, _ in rows if v is not None)))
    for n in (0, 1, 17, 401, 402, 999):
        assert ordered.offset_rows(df, n).count() == max(402 - n, 0)


def test_percentiles_of_few_keys_spread_over_tasks(spark):
    r = random.Random(5)
    rows = [(g, r.gauss(0, 100) if g else None, str(r.randrange(10**6))) for g in [1] * 3000 + [2] * 50 + [None, 0, 0]]
    df = spark.createDataFrame(rows, "g int, v double, t string")
    shares = {"lo": (0.0, False), "d": (0.37, False), "c": (0.5, True), "hi": (1.0, False)}
    of = {g: sorted(v for h, v, _ in rows if h == g and v is not None) for g in (0, 1, 2, None)}
    place = lambda v, s: v[max(math.ceil(s * len(v)) - 1, 0)] if v else None
    near = lambda x: tuple(None if y is None else round(y, 9) for y in x)
    got = ordered.percentiles(df, ["g"], "v", shares)
    want = {g: near((place(v, 0.0), place(v, 0.37), statistics.median(v) if v else None, place(v, 1.0))) for g, v in of.items()}
    assert {x["g"]: near(x[1:]) for x in got.collect()} == want
    assert ordered.percentiles(df, [], "t", {"d": (0.37, False)}).first()[0] == place(sorted(t for _, _, t in rows), 0.37)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Join" in line)  # no row is joined by its key alone


def test_recursion_of_many_rounds(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "a int, b int")
    step = lambda new: new.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n"))
    seed = spark.createDataFrame([(0,)], "n int")
    assert R.recursive_distinct(seed, step).count() == 21
    with pytest.raises(RuntimeError):
        R.recursive_distinct(seed, step, most=3)


def test_changes_domains_and_policies(spark):
    table = spark.createDataFrame([(1, "a", 5)], "id int, name string, val int")
    with pytest.raises(ValueError, match="no such column"):
        dml.insert_values(table, [(1,)], ["nothing"])
    with pytest.raises(ValueError, match="number of values"):
        dml.insert_values(table, [(1, "b")])
    got = dml.insert_values(table, [(2, dml.DEFAULT, None)], defaults={"name": F.lit("none")})
    assert values(got) == [(1, "a", 5), (2, "none", None)]
    with pytest.raises(Exception, match="no value of the domain"):
        one(spark, user.in_domain(F.lit(7), "int", lambda v: v < 5))
    assert one(spark, user.in_domain(F.lit(None).cast("int"), "int", lambda v: v < 5)) is None
    rules = Policies().add("ann", F.col("val") > 9)
    assert values(rules.visible(table, "ann")) == values(rules.visible(table, "bob")) == []


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 4000, 2).select(F.col("id").alias("k")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    bloom = profile.bloom_filter(keys, "k", 1 << 15, 5)
    assert len(bloom.first()["bloom"]) == 512
    passed = {r["k"] for r in profile.might_contain(spark.range(20_000).select(F.col("id").cast("int").alias("k")).union(spark.sql("SELECT CAST(NULL AS INT)")), "k", bloom, 1 << 15, 5).collect()}
    assert passed >= set(range(0, 4000, 2)) and len(passed) < 2000 + 18_000 * 0.05 and None not in passed


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 20_000).alias("v"), (F.col("id") % 3).alias("g"))
    whole = profile.estimates(profile.merged_sketches(profile.sketches(df, ["g"], "v"), [])).first()["n"]
    assert abs(whole / 20_000 - 1) < 0.03


def test_distinct_counts_hold_one_sketch(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 20_000).alias("v"))
    got = profile.distinct_counts(rows, "v")
    assert got.first().asDict() == rows.agg(profile.approx_distinct("v").alias("approximate")).first().asDict() | {"exact": 20_000}
    plan = catalog.queries()["stats_approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert found and all("keys=[]" in line for line in found)  # no sketch for each value
    assert profile.distinct_counts(rows.where("v < 0"), "v").first().asDict() == {"approximate": 0, "exact": 0}


def test_templates(spark):
    t = F.lit("2023-01-05 14:07:09").cast("timestamp_ntz")
    for template, want in (("YYYY-MM-DD HH24:MI:SS", "2023-01-05 14:07:09"), ('DY "the" DD', "THU the 05"), ("HH12 AM", "02 PM"), ("Month YY", "January 23"), ("T", "T")):
        assert one(spark, temporal.to_char(t, template)) == want
    assert str(one(spark, temporal.add_interval(F.lit("2024-01-31").cast("timestamp_ntz"), months=1))) == "2024-02-29 00:00:00"
    assert one(spark, temporal.to_date(F.lit("no date"), "YYYY-MM-DD")) is None


def test_session(spark):
    row = catalog.queries()["session_settings"](spark, "").first()
    assert row["user_name"] == row["session_name"] and row["schema_name"] == "default" and row["zone"] == "UTC"


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        files.shared_dir(Session)


def test_vectors_of_many_texts_stay_small(spark, monkeypatch):
    r = random.Random(7)
    words = ["The", "cats", "running", "flies", "ies", "été", "x_9", "s", "Relational", "of"]
    texts = [None, "", "-", *("".join(r.choice(words) + r.choice([" ", "", " - "]) for _ in range(r.randrange(60))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def plain(text, config):
        found = {}
        for k, w in enumerate(re.findall("[a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), 1):
            if (lexeme := search.lexeme_of(w, config)) is not None:
                found.setdefault(lexeme, []).append(k)
        return sorted(found.items())

    for config in ("english", "simple"):
        got = {x["id"]: [tuple(e) for e in x["vector"]] for x in search.to_tsvector(docs, "id", "t", config).collect()}
        assert got == {k: v for k, t in enumerate(texts) if (v := plain(t, config))}
        counts = collections.Counter(w for t in texts for w, _ in plain(t, config))
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [tuple(x) for x in search.lexeme_statistics(docs, "id", "t", 3, config).orderBy(F.desc("n"), "lexeme").collect()] == [(*x, counts.total() / len(texts)) for x in top]
    plan = search.lexeme_statistics(docs, "id", "t", 3, "simple")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    monkeypatch.setattr(search, "PART_BYTES", 8)  # a batch comes back in parts of few texts
    column = pa.array([b"aaaa", None, b"bbbb", b"c" * 30, b"dd"])
    assert [(first, len(part)) for first, part in search._parts(column)] == [(0, 3), (3, 1), (4, 1)]


def test_headline_and_cover_rank_read_what_they_need(spark):
    r = random.Random(11)
    pieces = ["the", "The", "LA", "la", "other", "x_the", "\u00e9t\u00e9", "\U0001f600", "la\u00e9", "9s"]
    texts = [None, "", "-", "the", "- the", "the la", "no term at all", *("".join(r.choice(pieces) + r.choice([" ", "", ", ", "\n"]) for _ in range(r.randrange(120))) for _ in range(80))]
    texts += ["x " * 300 + "the" + " y\U0001f600" * 300]
    query = search.Query.parse("the | la")

    def headline(text):
        spans = re.findall("[A-Za-z0-9_]+|[^A-Za-z0-9_]+", text)
        at = next((k for k, s in enumerate(spans) if s.lower() in ("the", "la")), 0)
        begin = max(at - 17, 0)
        count = 69 if spans and re.match("[A-Za-z0-9_]", spans[begin]) else 70
        return "".join(f"<b>{s}</b>" if s.lower() in ("the", "la") else s for s in spans[begin : begin + count])

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {x["id"]: x["h"] for x in df.select("id", search.ts_headline(F.col("t"), query).alias("h")).collect()}
    assert got == {k: None if t is None else headline(t) for k, t in enumerate(texts)}
    known = df.where("t IS NOT NULL")
    want = known.select("id", search.ts_rank_cd(search.term_vector(F.col("t"), query.terms()), query))
    assert values(known.select("id", search.text_rank_cd(F.col("t"), query))) == values(want)
    for name, lists in (("text_headline", "regexp_extract_all(text"), ("text_rank_cover", "translate(text")):  # of all words
        assert lists not in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_block_join_spreads_pairs_of_few_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 50)
    r = random.Random(13)
    make = lambda n: [(k, r.choice([1, 1, 1, 2, None]), r.choice([None, *range(9)])) for k in range(n)]
    xs, ys = make(240), make(130)
    x, y = spark.createDataFrame(xs, "a int, k int, v int"), spark.createDataFrame(ys, "b int, l int, w int")
    got = R.block_join(x, y, "k", "l", F.col("w") < F.col("v"))
    assert values(got.select("a", "b")) == sorted(((a, b) for a, k, v in xs for b, m, w in ys if None not in (k, m, v, w) and k == m and w < v), key=str)
    tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 4
