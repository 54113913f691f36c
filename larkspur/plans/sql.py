"""Queries in SQL: scans, predicates, joins, aggregates, windows, sorts, set operations, subqueries."""

from .catalog import register_sql as q

# scans, projection, predicates
q("scan_filter_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
q("scan_key_lookup", "SELECT * FROM part WHERE p_partkey IN (1, 17, 42, 99)")
q("scan_range_lookup", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 220")
q("values_scan", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, val)")
q("result_one_row", "SELECT 1 + 2 AS three, 'x' AS label")
q("series_scan", "SELECT CAST(id AS BIGINT) AS n, CAST(id * id AS BIGINT) AS sq FROM range(1, 101) AS t(id)", "SELECT CAST(range AS BIGINT) AS n, CAST(range * range AS BIGINT) AS sq FROM range(1, 101)")
q("series_null_bounds", "SELECT n_nationkey, explode(sequence(1, CASE WHEN n_regionkey <> 2 THEN n_regionkey + 1 END)) AS n FROM nation", "SELECT n_nationkey, CAST(unnest(range(1, CASE WHEN n_regionkey <> 2 THEN n_regionkey + 2 END)) AS INTEGER) AS n FROM nation")
q("subquery_scan", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE n > 10")
q("predicate_compare", "SELECT c_custkey, c_acctbal > 0 AS pos, c_acctbal <> 0 AS nz, c_mktsegment <= 'F' AS low, c_nationkey = 3 AS n3 FROM customer")
q("predicate_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, p_size DIV 7 AS d, p_size % 7 AS e, -p_size AS f FROM part", "SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, CAST(p_size // 7 AS BIGINT) AS d, p_size % 7 AS e, -p_size AS f FROM part")
q("predicate_safe_division", "SELECT p_partkey, 100.0D / nullif(p_size - 10, 0) AS x FROM part", "SELECT p_partkey, CAST(100.0 AS DOUBLE) / nullif(p_size - 10, 0) AS x FROM part")
q("predicate_power_concat", "SELECT p_partkey, power(CAST(p_size AS DOUBLE), 2) AS pw, p_brand || '-' || p_type AS label FROM part")
q("predicate_logic_null", "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 7 = 0 END AS b FROM customer) SELECT k, a AND b AS x, a OR b AS y, NOT a AS z, a IS NULL AS an, b IS NOT NULL AS bn, a IS TRUE AS t1, b IS FALSE AS f1, a IS DISTINCT FROM b AS df FROM t")
q("predicate_in_list", "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS n FROM customer) SELECT k, n IN (1, 2, 3) AS a, n NOT IN (1, 2, 3) AS b, n IN (1, NULL) AS c FROM t")
q("predicate_any_all", "SELECT p_partkey, exists(array(5, 10, 15), x -> x = p_size) AS any_eq, forall(array(5, 10, 15), x -> x < p_size) AS all_lt FROM part", "SELECT p_partkey, p_size = ANY([5, 10, 15]) AS any_eq, p_size > 15 AS all_lt FROM part")
q("predicate_between", "SELECT p_partkey, p_size BETWEEN 5 AND 20 AS a, p_size NOT BETWEEN 5 AND 20 AS b, p_size BETWEEN least(30, 10) AND greatest(30, 10) AS sym FROM part")
q("predicate_like", r"SELECT p_partkey, p_type LIKE '%STEEL%' AS a, p_type NOT LIKE 'S%' AS b, lower(p_brand) LIKE 'brand#_%' AS c, p_type ILIKE '%steel' AS d, p_brand LIKE 'Brand##1%' ESCAPE '#' AS e FROM part")
q("predicate_similar_regex", "SELECT p_partkey, p_brand RLIKE '^(?:Brand#(1|2).*)$' AS a, p_type RLIKE 'EE+L' AS b, NOT p_type RLIKE 'TIN' AS c FROM part", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#(1|2).*') AS a, regexp_matches(p_type, 'EE+L') AS b, NOT regexp_matches(p_type, 'TIN') AS c FROM part")
q("expr_case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS size_class FROM part")
q("expr_case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
q("expr_coalesce_nullif", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'none') AS a, nullif(c_nationkey, 3) AS b, greatest(c_nationkey, 10, NULL) AS g, least(c_nationkey, 10) AS l FROM customer")
q("expr_cast", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(trunc_price AS BIGINT) AS b, CAST('42' AS INT) AS i, CAST(p_size AS DOUBLE) AS d, CAST('2024-02-29' AS DATE) AS dt, CAST(p_size > 10 AS INT) AS bi FROM (SELECT *, floor(p_retailprice) AS trunc_price FROM part) t", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(floor(p_retailprice) AS BIGINT) AS b, CAST('42' AS INTEGER) AS i, CAST(p_size AS DOUBLE) AS d, CAST('2024-02-29' AS DATE) AS dt, CAST(p_size > 10 AS INTEGER) AS bi FROM part")
q("expr_array_row", "SELECT p_partkey, array(p_size, 1, 2)[0] AS first_el, slice(array(p_size, 1, 2), 2, 2)[1] AS last_el, struct(p_size AS a, p_brand AS b).b AS field FROM part", "SELECT p_partkey, [p_size, 1, 2][1] AS first_el, [p_size, 1, 2][2:3][2] AS last_el, {'a': p_size, 'b': p_brand}.b AS field FROM part")
q("predicate_truth_tests", "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS a FROM customer) SELECT k, a IS TRUE AS t, a IS NOT TRUE AS nt, a IS FALSE AS f, a IS NOT FALSE AS nf, a IS UNKNOWN AS u, a IS NOT UNKNOWN AS nu FROM t", "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS a FROM customer) SELECT k, a IS TRUE AS t, a IS NOT TRUE AS nt, a IS FALSE AS f, a IS NOT FALSE AS nf, a IS NULL AS u, a IS NOT NULL AS nu FROM t")

# joins
q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
q("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o RIGHT JOIN customer ON c_custkey = o_custkey")
q("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON s_suppkey = c_custkey + 30")
q("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("join_anti_null_keys", "WITH c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k, c_name FROM customer) SELECT k, c_name FROM c LEFT ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON k = o_custkey", "WITH c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k, c_name FROM customer) SELECT k, c_name FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND k = o_custkey)")
q("join_theta", "SELECT r.r_regionkey AS a, n.n_nationkey AS b FROM region r JOIN nation n ON n.n_nationkey > r.r_regionkey * 5")
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
q("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
q("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("join_multiway", "SELECT r_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
q("join_duplicates_both_sides", "SELECT a.o_custkey AS k, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey")
q("join_empty_side", "SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1000) r ON n_regionkey = r_regionkey")
q("join_null_safe", "WITH a AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 3 END AS k, n_nationkey FROM nation) SELECT x.n_nationkey AS p, y.n_nationkey AS q FROM a x JOIN a y ON x.k IS NOT DISTINCT FROM y.k")

# aggregates
q("agg_plain", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS d, min(l_shipdate) AS lo, max(l_shipdate) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_returnflag) AS f FROM lineitem")
q("agg_empty_input", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_returnflag) AS m FROM lineitem WHERE l_orderkey < 0")
q("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("agg_null_group", "SELECT CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END AS g, count(*) AS n, count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) AS even FROM customer GROUP BY 1")
q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 1000")
q("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS d, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority")
q("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, CAST(sum(o_custkey) FILTER (WHERE o_custkey % 2 = 0) AS BIGINT) AS even FROM orders GROUP BY o_orderstatus")
q("agg_expression_key", "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10")
q("agg_over_aggregates", "SELECT o_orderstatus, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS ratio FROM orders GROUP BY o_orderstatus")
q("agg_ordered_list", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
q("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g1 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
q("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("agg_group_only", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment")
q("agg_decimal_avg", "SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS a FROM lineitem GROUP BY l_returnflag")
q("agg_bool", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS every_pos, bool_or(o_totalprice > 400000) AS any_big FROM orders GROUP BY o_orderstatus")

# windows
q("window_ranking", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
q("window_offset", "SELECT o_orderkey, lag(o_orderkey, 1, -1L) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
q("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
q("window_running_rows", "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS s, count(*) OVER w AS n, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
q("window_whole_partition", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders")
q("window_rows_sliding", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders")
q("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
q("window_null_partition", "SELECT c_custkey, count(*) OVER (PARTITION BY CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_nationkey END) AS n FROM customer")
q("window_distribution", "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS nt, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS cd FROM part")

# sort, limit, distinct
q("sort_nulls_last", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) t ORDER BY v DESC NULLS LAST, k ASC NULLS LAST")
q("sort_nulls_first", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) t ORDER BY v ASC NULLS FIRST, k")
q("sort_alias_ordinal", "SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, 1")
q("topn_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
q("limit_plain_count", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 17) t")
q("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# set operations
q("setop_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
q("setop_union", "SELECT n_regionkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
q("setop_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
q("setop_intersect_all", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
q("setop_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
q("setop_except_all", "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation")
q("setop_nulls_equal", "SELECT CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey END AS k FROM nation INTERSECT SELECT CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_nationkey END FROM supplier")
q("setop_mixed_types", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION SELECT s_suppkey FROM supplier")

# CTEs, subqueries
q("cte_chained", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b WHERE m > 1")
q("cte_column_names", "WITH t(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM t WHERE a > 3")
q("cte_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
q("subquery_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
q("subquery_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000)")
q("subquery_not_exists", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9950)")
q("subquery_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) - 500 FROM supplier)")
q("subquery_correlated", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part")
q("subquery_lateral", "SELECT n_name, x.twice FROM nation, LATERAL (SELECT n_nationkey * 2 AS twice) x")
