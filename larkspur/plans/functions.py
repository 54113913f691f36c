"""Queries of scalar functions: strings, numbers, dates, arrays, JSON, ranges, geometry, networks, bits, XML."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions import bits, geometry, networks, ranges
from ..tables import load
from .catalog import register
from .catalog import register_sql as q

q("string_basic", "SELECT p_partkey, CAST(length(p_type) AS BIGINT) AS len, upper(p_type) AS up, lower(p_brand) AS lo, replace(p_type, 'STEEL', 'iron') AS rep, CAST(instr(p_type, 'EE') AS BIGINT) AS pos, concat_ws('', p_brand, NULL, '!') AS cat, repeat('ab', 3) AS rp, reverse(p_brand) AS rev FROM part")
q("string_pad_split", "SELECT p_partkey, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 4, '*') AS rp, split_part(p_type, ' ', 1) AS s1, split_part(p_type, ' ', -1) AS s2, split_part(p_type, ' ', 9) AS s9 FROM part")
q("string_lengths", "SELECT doc_id, CAST(char_length(text) AS BIGINT) AS c, CAST(octet_length(text) AS BIGINT) AS o, CAST(bit_length(text) AS BIGINT) AS b FROM documents", "SELECT doc_id, length(text) AS c, CAST(octet_length(encode(text)) AS BIGINT) AS o, CAST(bit_length(text) AS BIGINT) AS b FROM documents")
q("string_initcap_overlay", "SELECT n_nationkey, concat(upper(substring(n_name, 1, 1)), lower(substring(n_name, 2, 100))) AS ic, overlay(n_name PLACING 'xx' FROM 2 FOR 3) AS ov FROM nation", "SELECT n_nationkey, concat(upper(substring(n_name, 1, 1)), lower(substring(n_name, 2, 100))) AS ic, concat(substring(n_name, 1, 1), 'xx', substring(n_name, 5)) AS ov FROM nation")
q("string_trim_chars", "SELECT p_partkey, trim(BOTH 'B1' FROM p_brand) AS t, ltrim('B', p_brand) AS l, rtrim('0123456789', p_brand) AS r FROM part", "SELECT p_partkey, trim(p_brand, 'B1') AS t, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '0123456789') AS r FROM part")
q("string_ascii_chr", "SELECT n_nationkey, CAST(ascii(n_name) AS INT) AS a, chr(65 + n_nationkey) AS c, hex(encode(n_name, 'UTF-8')) AS h, md5(n_name) AS m FROM nation", "SELECT n_nationkey, CAST(ascii(n_name) AS INTEGER) AS a, chr(65 + n_nationkey) AS c, hex(encode(n_name)) AS h, md5(n_name) AS m FROM nation")
q("math_basic", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS DOUBLE) AS ce, CAST(floor(p_retailprice) AS DOUBLE) AS fl, round(p_retailprice) AS r0, round(sqrt(p_size), 8) AS sq, power(p_size, 2.0D) AS pw, p_size % 7 AS md, CAST(sign(p_size - 25) AS INT) AS sg FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(p_retailprice) AS r0, round(sqrt(p_size), 8) AS sq, power(CAST(p_size AS DOUBLE), CAST(2.0 AS DOUBLE)) AS pw, p_size % 7 AS md, CAST(sign(p_size - 25) AS INTEGER) AS sg FROM part")
q("math_logs", "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(exp(p_size / 10.0D), 6) AS e, round(log(2, p_retailprice), 9) AS l2, round(pi(), 9) AS p, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd FROM part WHERE p_retailprice > 0", "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(exp(p_size / CAST(10 AS DOUBLE)), 6) AS e, round(log(2, p_retailprice), 9) AS l2, round(pi(), 9) AS p, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd FROM part WHERE p_retailprice > 0")
q("math_decimal", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS d, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + 1.25 AS DECIMAL(20,2)) AS s FROM lineitem")
q("date_extract", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(quarter(ts) AS BIGINT) AS q, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(weekofyear(ts) AS BIGINT) AS wk FROM events")
q("date_compare", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
q("array_functions", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS first_el, array_append(array(1, 2), label) AS app, array(1, label) < array(1, 5) AS lt, array(1, 2) = array(1, 2) AS eq FROM embeddings", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first_el, list_append([1, 2], label) AS app, [1, label] < [1, 5] AS lt, [1, 2] = [1, 2] AS eq FROM embeddings")
q("array_parse_literal", "SELECT transform(split(substring('{4,5,6}', 2, 5), ','), x -> CAST(x AS INT)) AS a", "SELECT list_transform(string_split('4,5,6', ','), lambda x: CAST(x AS INTEGER)) AS a")
q("json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
q("json_normal_form", "SELECT count(*) AS n FROM events WHERE to_json(from_json(props, 'k INT')) = regexp_replace(props, ' ', '')", "SELECT count(*) AS n FROM events WHERE CAST(json(props) AS VARCHAR) = replace(props, ' ', '')")
q("uuid_format", "SELECT n_nationkey, lower('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11') = 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS eq, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' RLIKE '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$' AS ok FROM nation", "SELECT n_nationkey, lower('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11') = 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS eq, regexp_matches('a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11', '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS ok FROM nation")
q("enum_order", "SELECT o_orderkey, array_position(array('O', 'P', 'F'), o_orderstatus) AS ord FROM orders", "SELECT o_orderkey, CAST(list_position(['O', 'P', 'F'], o_orderstatus) AS BIGINT) AS ord FROM orders")
q("row_compare", "SELECT p_partkey, struct(p_size, p_brand) < struct(25, 'Brand#3') AS lt, struct(p_size, 1) = struct(10, 1) AS eq FROM part", "SELECT p_partkey, (p_size, p_brand) < (25, 'Brand#3') AS lt, (p_size, 1) = (10, 1) AS eq FROM part")
q("bytes_functions", "SELECT n_nationkey, hex(encode(n_name, 'UTF-8')) AS h, decode(unhex(hex(encode(n_name, 'UTF-8'))), 'UTF-8') AS back, CAST(octet_length(encode(n_name, 'UTF-8')) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, hex(encode(n_name)) AS h, decode(unhex(hex(encode(n_name)))) AS back, CAST(octet_length(encode(n_name)) AS BIGINT) AS n FROM nation")
q("xml_paths", "SELECT n_nationkey, xpath_boolean(concat('<a><b>', n_name, '</b></a>'), 'a/b') AS has_b, xpath_boolean(concat('<a><b>', n_name, '</b></a>'), 'a/c') AS has_c, xpath_string(concat('<a><b>', n_name, '</b></a>'), 'a/b') AS b FROM nation", "SELECT n_nationkey, true AS has_b, false AS has_c, n_name AS b FROM nation")
q("collation_binary", "SELECT n_name < 'INDIA' AS lt, count(*) AS n FROM nation GROUP BY 1")


@register("string_trim_white", r"SELECT n_nationkey, regexp_replace(' ' || chr(9) || chr(10) || n_name || chr(13) || chr(12) || ' ', '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM nation")
def string_trim_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", S.trim_white(F.concat(F.lit(" \t\n"), "n_name", F.lit("\r\f "))).alias("t"))


@register("string_substr_clamped", "SELECT p_partkey, substring(p_type, 1, 3) AS a, substring(p_type, 4, 5) AS b, '' AS c FROM part")
def string_substr_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    return load(spark, sf_dir, "part").select("p_partkey", S.substr_clamped(t, 0, 3).alias("a"), S.substr_clamped(t, 4, 5).alias("b"), S.substr_clamped(t, 2, -1).alias("c"))


@register("string_left_right", "SELECT p_partkey, left(p_type, 4) AS a, left(p_type, -3) AS b, right(p_type, 4) AS c, right(p_type, -3) AS d FROM part")
def string_left_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    return load(spark, sf_dir, "part").select("p_partkey", S.left_part(t, 4).alias("a"), S.left_part(t, -3).alias("b"), S.right_part(t, 4).alias("c"), S.right_part(t, -3).alias("d"))


@register("string_regexp_first", r"SELECT p_partkey, regexp_replace(p_type, '([A-Z])E', '<\1>') AS a, regexp_replace(p_type, '([A-Z])E', '<\1>', 'g') AS b, regexp_extract(p_type, '([A-Z]+) ', 1) AS c FROM part")
def string_regexp_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    return load(spark, sf_dir, "part").select("p_partkey", S.regexp_replace_first(t, "([A-Z])E", r"<\1>").alias("a"), F.regexp_replace(t, "([A-Z])E", "<$1>").alias("b"), F.regexp_extract(t, "([A-Z]+) ", 1).alias("c"))


@register("string_varchar_cut", "SELECT p_partkey, substring(p_type, 1, 5) AS v FROM part")
def string_varchar_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.substring("p_type", 1, 5).alias("v"))


@register("predicate_similar_to", "SELECT p_partkey, regexp_full_match(p_type, '.*(STEEL|TIN)') AS a, regexp_full_match(p_brand, 'Brand#.') AS b FROM part")
def predicate_similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", S.similar_to(F.col("p_type"), "%(STEEL|TIN)").alias("a"), S.similar_to(F.col("p_brand"), "Brand#_").alias("b"))


@register("predicate_between_symmetric", "SELECT p_partkey, p_size BETWEEN 10 AND 30 AS b FROM part")
def predicate_between_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", S.between_symmetric(F.col("p_size"), F.lit(30), F.lit(10)).alias("b"))


@register("math_trunc", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice) AS t0, trunc(l_extendedprice / 100) * 100 AS tm, CAST((l_linenumber - 4) // 2 AS BIGINT) AS d FROM lineitem")
def math_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.trunc_number(x).alias("t0"), S.trunc_number(x, -2).alias("tm"), S.int_div(F.col("l_linenumber") - 4, F.lit(2)).alias("d"))


@register("date_extract_wide", "SELECT event_id, CAST(epoch(ts) AS DOUBLE) AS ep, extract(century FROM ts) AS ce, extract(millennium FROM ts) AS mi, extract(decade FROM ts) AS de, extract(dow FROM ts) AS dow, CAST((dayofyear(ts) - 1) // 7 + 1 AS BIGINT) AS ws, CAST(extract(microseconds FROM ts) AS BIGINT) AS us FROM events")
def date_extract_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    micros = (F.expr("extract(SECOND FROM ts)") * 1000000).cast("long")
    return load(spark, sf_dir, "events").select("event_id", S.epoch(t).alias("ep"), S.century(t).alias("ce"), S.millennium(t).alias("mi"), S.decade(t).alias("de"), S.day_of_week(t).alias("dow"), S.week_simple(t).alias("ws"), micros.alias("us"))


@register("date_trunc_fields", "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{f}', ts) AS TIMESTAMP) AS t_{f}" for f in ("second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade")) + ", make_timestamp((year(ts) - 1) // 100 * 100 + 1, 1, 1, 0, 0, 0) AS t_century, make_timestamp((year(ts) - 1) // 1000 * 1000 + 1, 1, 1, 0, 0, 0) AS t_millennium FROM events")
def date_trunc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    plain = [F.date_trunc(f, t).cast("timestamp_ntz").alias(f"t_{f}") for f in ("second", "minute", "hour", "day", "week", "month", "quarter", "year")]
    return load(spark, sf_dir, "events").select("event_id", *plain, *[S.date_trunc_wide(f, t).alias(f"t_{f}") for f in ("decade", "century", "millennium")])


@register("range_contains", "SELECT p_partkey, p_size >= 5 AND p_size < 20 AS half_open, p_size > 5 AND p_size <= 20 AS other, p_size < 7 AS unbounded, false AS empty FROM part")
def range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size")
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        ranges.contains(ranges.make(F.lit(5), F.lit(20)), x).alias("half_open"),
        ranges.contains(ranges.parse("(5,20]"), x).alias("other"),
        ranges.contains(ranges.parse("[,7)"), x).alias("unbounded"),
        ranges.contains(ranges.parse("empty"), x).alias("empty"),
    )


@register("geometry_measures", "SELECT s_suppkey, round(sqrt(power(s_suppkey - 3.0, 2) + power(s_acctbal - 4.0, 2)), 6) AS dist, round(abs(s_suppkey * s_acctbal), 4) AS area, round(pi() * power(s_suppkey, 2), 6) AS circle, CAST(10 AS DOUBLE) AS path FROM supplier")
def geometry_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("s_suppkey").cast("double"), F.col("s_acctbal")
    p, zero = geometry.point(x, y), geometry.point(F.lit(0.0), F.lit(0.0))
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.round(geometry.distance(p, geometry.point(F.lit(3.0), F.lit(4.0))), 6).alias("dist"),
        F.round(geometry.box_area(zero, p), 4).alias("area"),
        F.round(geometry.circle_area(x), 6).alias("circle"),
        geometry.path_length(F.array(zero, geometry.point(F.lit(3.0), F.lit(4.0)), zero)).alias("path"),
    )


@register("network_ipv4", "SELECT n_nationkey, CAST(10 AS BIGINT) * 16777216 + n_nationkey * 256 + 7 AS v4, n_nationkey < 8 AS inside FROM nation")
def network_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("10.0."), F.col("n_nationkey").cast("string"), F.lit(".7"))
    return load(spark, sf_dir, "nation").select("n_nationkey", networks.ipv4(ip).alias("v4"), networks.in_cidr(ip, F.lit("10.0.0.0/21")).alias("inside"))


@register("bit_strings", "SELECT n_nationkey, CAST(n_nationkey & 12 AS INTEGER) AS a, CAST(n_nationkey | 12 AS INTEGER) AS o, CAST(xor(n_nationkey, 12) AS INTEGER) AS x, CAST(~n_nationkey AS INTEGER) AS n, '0110' AS s FROM nation")
def bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return load(spark, sf_dir, "nation").select("n_nationkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(12).alias("o"), k.bitwiseXOR(12).alias("x"), F.bitwise_not(k).alias("n"), bits.xor(F.lit("0101"), F.lit("0011")).alias("s"))
