"""Queries of compound types: arrays, JSON, ranges, geometry, networks, XML, character sets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, encodings, geometry, networks, ranges
from ..tables import load
from .catalog import register


@register("array_literals", "SELECT n_nationkey, [n_nationkey, n_regionkey, NULL] AS flat, [[n_nationkey, 2], [3, n_regionkey]] AS nested, '{' || n_nationkey || ',' || n_regionkey || ',NULL}' AS back FROM nation")
def array_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    flat, nested = F.format_string("{%d,%d,NULL}", k, r), F.format_string("{{%d,2},{3,%d}}", k, r)
    return load(spark, sf_dir, "nation").select("n_nationkey", arrays.parse(flat).alias("flat"), arrays.parse(nested, dimensions=2).alias("nested"), arrays.text(arrays.parse(flat)).alias("back"))


@register("array_dimensions", "SELECT n_nationkey, 2 AS ndims, len([[1, 2, 3], [4, 5, n_regionkey]]) AS len1, len([[1, 2, 3], [4, 5, n_regionkey]][1]) AS len2, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS len_empty FROM nation")
def array_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("n_regionkey")
    a = F.array(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(4), F.lit(5), r))
    rows = load(spark, sf_dir, "nation").select("n_nationkey", a.alias("a"), F.array_repeat(F.lit(1), r).alias("e"))
    return rows.select("n_nationkey", F.lit(arrays.dimensions(rows.schema["a"].dataType)).alias("ndims"), arrays.length(F.col("a")).alias("len1"), arrays.length(F.col("a"), 2).alias("len2"), arrays.length(F.col("e")).alias("len_empty"))


@register("array_ordering", "SELECT n_nationkey, [n_regionkey, 3] < [2, 1] AS lt, [n_regionkey] < [n_regionkey, 0] AS prefix, [1, n_regionkey] <> [1, 2] AS ne, CASE WHEN [n_regionkey, 3] < [2, 1] THEN -1 WHEN [n_regionkey, 3] = [2, 1] THEN 0 ELSE 1 END AS cmp FROM nation")
def array_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("n_regionkey")
    a, b = F.array(r, F.lit(3)), F.array(F.lit(2), F.lit(1))
    return load(spark, sf_dir, "nation").select("n_nationkey", (a < b).alias("lt"), (F.array(r) < F.array(r, F.lit(0))).alias("prefix"), (F.array(F.lit(1), r) != F.array(F.lit(1), F.lit(2))).alias("ne"), F.when(a < b, -1).when(a == b, 0).otherwise(1).alias("cmp"))


@register(
    "json_nested",
    """SELECT n_nationkey, '{"a":[1,{"c":"' || n_name || '"},null],"b":{"x":' || n_nationkey || ',"y":true}}' AS normal, n_name AS c, n_nationkey AS x, 3 AS n, n_regionkey = 1 AS same FROM nation""",
)
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{ "b" : {"y":true, "x": %d}, "a":[1, {"c":"%s"}, null ] }', F.col("n_nationkey"), F.col("n_name"))
    other = F.format_string('{"p":1,"r":%d}', F.col("n_regionkey"))
    normal = lambda x: F.to_json(F.parse_json(x))
    return load(spark, sf_dir, "nation").select("n_nationkey", normal(text).alias("normal"), F.get_json_object(text, "$.a[1].c").alias("c"), F.get_json_object(text, "$.b.x").cast("int").alias("x"), F.json_array_length(F.get_json_object(text, "$.a")).alias("n"), (normal(other) == normal(F.lit('{ "r":1, "p":1 }'))).alias("same"))


@register(
    "range_compare",
    "SELECT p_partkey, CASE WHEN p_size < 10 OR p_size = 10 AND p_size + 5 < 20 THEN -1 WHEN p_size = 10 AND p_size + 5 = 20 THEN 0 ELSE 1 END AS cmp, p_size = 10 AS same_lower, p_size < 10 OR p_size = 10 AS below_closed, 1 AS to_empty, '[' || p_size || ',' || (p_size + 5) || ')' AS body, '(,' || p_size || ']' AS open_body FROM part",
)
def range_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size")
    r, other = ranges.make(x, x + 5), ranges.make(F.lit(10), F.lit(20))
    none = F.lit(None).cast("int")
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        ranges.compare(r, other).alias("cmp"),
        (ranges.compare(ranges.make(x, F.lit(60)), ranges.make(F.lit(10), F.lit(60))) == 0).alias("same_lower"),
        (ranges.compare(r, ranges.make(F.lit(10), F.lit(90), lower_inc=False)) < 0).alias("below_closed"),
        ranges.compare(r, ranges.parse("empty")).alias("to_empty"),
        ranges.text(r).alias("body"),
        ranges.text(ranges.make(none, x, upper_inc=True)).alias("open_body"),
    )


@register(
    "geometry_shapes",
    "SELECT s_suppkey, round(sqrt(power(s_suppkey - 1.0, 2) + power(s_acctbal, 2)), 6) AS seg, abs(CAST(s_suppkey AS DOUBLE) - 2) AS width, round(abs(s_acctbal - 3.0), 6) AS height, CAST(s_suppkey AS DOUBLE) AS radius, 3 AS corners, CAST(12 AS DOUBLE) AS outline FROM supplier",
)
def geometry_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: geometry.point(F.lit(float(x)), F.lit(float(y)))
    p = geometry.point(F.col("s_suppkey"), F.col("s_acctbal"))
    triangle = F.array(at(0, 0), at(3, 0), at(3, 4))
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.round(geometry.segment_length(geometry.segment(p, at(1, 0))), 6).alias("seg"),
        geometry.box_width(p, at(2, 3)).alias("width"),
        F.round(geometry.box_height(p, at(2, 3)), 6).alias("height"),
        geometry.circle_radius(geometry.circle(p, F.col("s_suppkey"))).alias("radius"),
        geometry.count_points(triangle).alias("corners"),
        geometry.polygon_length(triangle).alias("outline"),
    )


@register("network_ipv6", "SELECT n_nationkey, '2001:db8::' || lower(hex(n_nationkey + 1)) AS short, NULL AS none FROM nation")
def network_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.format_string("2001:0DB8:0:0:0:0:0:%04x", F.col("n_nationkey") + 1)
    return load(spark, sf_dir, "nation").select("n_nationkey", networks.ipv6_text(long).alias("short"), networks.ipv6_text(F.concat(long, F.lit(":1"))).alias("none"))


@register("network_mac", "SELECT n_nationkey, '08:00:2b:01:02:' || lower(right('0' || hex(n_nationkey), 2)) AS mac, NULL AS none, n_nationkey < 7 AS below FROM nation")
def network_mac(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("08002B-0102%02X", F.col("n_nationkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey", networks.mac(text).alias("mac"), networks.mac(F.lit("08002B-01020")).alias("none"), (networks.mac(text) < networks.mac(F.lit("08:00:2b:01:02:07"))).alias("below"))


@register("xml_documents", "SELECT n_nationkey, n_nationkey % 2 = 0 AS valid, '<r><b>' || n_name || '</b><c/></r>' AS joined, true AS has_c FROM nation")
def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.concat(F.lit("<b>"), F.col("n_name"), F.lit("</b>"))
    whole = F.concat(F.lit("<r>"), b, F.when(F.col("n_nationkey") % 2 == 0, "</r>").otherwise("</q>"))
    parsed = F.from_xml(whole, "b STRING, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    joined = F.concat(F.lit("<r>"), b, F.lit("<c/>"), F.lit("</r>"))
    return load(spark, sf_dir, "nation").select("n_nationkey", (parsed["_corrupt_record"].isNull() & parsed.isNotNull()).alias("valid"), joined.alias("joined"), F.xpath_boolean(joined, F.lit("r/c")).alias("has_c"))


@register("encoding_latin1", "SELECT n_nationkey, hex(encode(n_name)) || 'E9' AS bytes, n_name || 'é' AS back, NULL AS none FROM nation")
def encoding_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("n_name", F.lit("é"))
    data = encodings.encode(text, "ISO-8859-1")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.hex(data).alias("bytes"), encodings.decode(data, "ISO-8859-1").alias("back"), F.hex(encodings.encode(F.concat("n_name", F.lit("中")), "ISO-8859-1")).alias("none"))


@register("encoding_gbk", "SELECT n_nationkey, hex(encode(n_name)) || 'D6D0CEC4' AS bytes, n_name || '中文' AS back, 1 AS w1, 3 AS w3 FROM nation")
def encoding_gbk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = encodings.encode(F.concat("n_name", F.lit("中文")), "GBK")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.hex(data).alias("bytes"), encodings.decode(data, "GBK").alias("back"), encodings.char_width(F.encode("n_name", "UTF-8")).alias("w1"), encodings.char_width(F.encode(F.concat(F.lit("中"), "n_name"), "UTF-8")).alias("w3"))
