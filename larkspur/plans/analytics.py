"""The shapes of a 43-query web analytics workload, on events, lineitem and orders."""

from .catalog import register_sql as q

q("web_count", "SELECT count(*) AS n FROM events")
q("web_count_filter", "SELECT count(*) AS n FROM events WHERE event_type <> 'click'")
q("web_multi_aggregate", "SELECT CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n, CAST(sum(user_id) AS DOUBLE) / count(*) AS a, min(ts) AS lo, max(ts) AS hi FROM events")
q("web_count_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
q("web_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
q("web_top_two_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10")
q("web_group_distinct", "SELECT event_type, count(DISTINCT user_id) AS u, count(*) AS n FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10")
q("web_text_filter_group", "SELECT source, count(*) AS n, min(text) AS first_text FROM documents WHERE text LIKE '%the%' AND text NOT LIKE '%zzz%' GROUP BY source ORDER BY n DESC, source LIMIT 10")
q("web_average", "SELECT CAST(sum(user_id) AS DOUBLE) / count(user_id) AS a FROM events")
q("web_count_distinct_text", "SELECT count(DISTINCT text) AS n FROM documents")
q("web_min_max_date", "SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events")
q("web_filter_group_all", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, event_type")
q("web_group_mixed", "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS s, count(*) AS c, CAST(sum(length(props)) AS DOUBLE) / count(*) AS a, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10")
q("web_text_key_distinct", "SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10")
q("web_two_keys_distinct", "SELECT event_type, props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10")
q("web_text_key_count", "SELECT props, count(*) AS c FROM events WHERE props <> '' GROUP BY props ORDER BY c DESC, props LIMIT 10")
q("web_filtered_two_keys", "SELECT user_id, props, count(*) AS c FROM events WHERE props <> '' GROUP BY user_id, props ORDER BY c DESC, user_id, props LIMIT 10")
q("web_two_keys_any", "SELECT count(*) AS n FROM (SELECT user_id, props, count(*) AS c FROM events GROUP BY user_id, props LIMIT 10) t")
q("web_text_key_min", "SELECT source, min(text) AS lo, count(*) AS c FROM documents WHERE text LIKE '%the%' AND source <> '' GROUP BY source ORDER BY c DESC, source LIMIT 10")
q("web_text_key_mins", "SELECT lang, min(text) AS lo, min(source) AS src, count(*) AS c, count(DISTINCT n_chars) AS u FROM documents WHERE text LIKE '%The%' AND text NOT LIKE '%.the.%' AND lang <> '' GROUP BY lang ORDER BY c DESC, lang LIMIT 10")
q("web_whole_rows_by_time", "SELECT * FROM events WHERE props LIKE '%7%' ORDER BY ts, event_id LIMIT 10")
q("web_order_by_text", "SELECT props FROM events WHERE props <> '' ORDER BY props LIMIT 10")
q("web_order_by_time_text", "SELECT props FROM events WHERE props <> '' ORDER BY ts, props LIMIT 10")
q("web_having_average", "SELECT source, CAST(sum(length(text)) AS DOUBLE) / count(*) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY source HAVING count(*) > 3 ORDER BY l DESC, source LIMIT 25")
q("web_filtered_pair_sums", "SELECT l_suppkey, l_linenumber, count(*) AS c, CAST(sum(l_partkey) AS BIGINT) AS s, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS a FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey, l_linenumber ORDER BY c DESC, l_suppkey, l_linenumber LIMIT 10")
q("web_unique_pair_sums", "SELECT l_orderkey, l_suppkey, count(*) AS c, CAST(sum(l_partkey) AS BIGINT) AS s, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS a FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_suppkey ORDER BY c DESC, l_orderkey, l_suppkey LIMIT 10")
q("web_long_text_key", "SELECT url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10")
q("web_views_by_title", "SELECT props, count(*) AS views FROM events WHERE user_id = 62 AND ts >= TIMESTAMP_NTZ '2024-01-01' AND ts <= TIMESTAMP_NTZ '2024-01-31' AND value > 0 AND props <> '' GROUP BY props ORDER BY views DESC, props LIMIT 10", "SELECT props, count(*) AS views FROM events WHERE user_id = 62 AND ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' AND value > 0 AND props <> '' GROUP BY props ORDER BY views DESC, props LIMIT 10")
q("web_views_offset", "SELECT user_id, count(*) AS views FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-02' AND event_type <> 'error' AND value <> 0 GROUP BY user_id ORDER BY views DESC, user_id LIMIT 10 OFFSET 100", "SELECT user_id, count(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND event_type <> 'error' AND value <> 0 GROUP BY user_id ORDER BY views DESC, user_id LIMIT 10 OFFSET 100")
q("web_case_two_keys_offset", "SELECT event_type, CASE WHEN user_id % 2 = 0 AND value > 50 THEN props ELSE '' END AS src, user_id AS dst, count(*) AS views FROM events GROUP BY 1, 2, 3 ORDER BY views DESC, event_type, src, dst LIMIT 10 OFFSET 20")
q("web_hash_day_offset", "SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS views FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, CAST(ts AS DATE) ORDER BY views DESC, user_id, d LIMIT 10 OFFSET 100")
q("web_two_numbers_offset", "SELECT user_id % 13 AS w, user_id % 7 AS h, count(*) AS views FROM events WHERE value > 1 GROUP BY user_id % 13, user_id % 7 ORDER BY views DESC, w, h LIMIT 10 OFFSET 50")
q("web_minute_key", "SELECT user_id, minute(ts) AS m, count(*) AS n FROM events GROUP BY user_id, minute(ts) ORDER BY n DESC, user_id, m LIMIT 20", "SELECT user_id, CAST(minute(ts) AS INTEGER) AS m, count(*) AS n FROM events GROUP BY user_id, minute(ts) ORDER BY n DESC, user_id, m LIMIT 20")
q("web_trunc_minute", "SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ) AS m, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 20 OFFSET 10", "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 20 OFFSET 10")
q("web_point_lookup", "SELECT event_id, user_id FROM events WHERE event_id = 77")
q("web_like_count", "SELECT count(*) AS n FROM events WHERE props LIKE '%1%'")
q("web_order_limit", "SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 10")
q("web_having_length", "SELECT lang, CAST(sum(length(text)) AS DOUBLE) / count(*) AS l, count(*) AS n FROM documents WHERE text <> '' GROUP BY lang HAVING count(*) > 5")
q("web_regex_key", "SELECT regexp_replace(url, '^https?://(?:www\\\\.)?([^/]+)/.*$', '$1') AS host, count(*) AS n, CAST(sum(length(html)) AS DOUBLE) / count(*) AS l FROM pages GROUP BY 1", r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS host, count(*) AS n, CAST(sum(length(html)) AS DOUBLE) / count(*) AS l FROM pages GROUP BY 1")
q("web_wide_sums", "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM events")
q("web_constant_key", "SELECT 1 AS one, event_type, count(*) AS n FROM events GROUP BY 1, event_type")
q("web_derived_keys", "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY n DESC, user_id LIMIT 10")
q("web_conjunctive_dates", "SELECT event_type, count(*) AS n FROM events WHERE user_id > 2 AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20' AND value > 10 GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE user_id > 2 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value > 10 GROUP BY event_type")
q("web_case_key", "SELECT CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'even click' ELSE '' END AS src, count(*) AS n FROM events GROUP BY 1")
q("web_in_list_hash", "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id IN (1, 3, 6) GROUP BY user_id")
q("web_group_stats", "SELECT l_suppkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS a FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10")
q("web_high_cardinality", "SELECT l_orderkey, l_partkey, count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey ORDER BY c DESC, l_orderkey, l_partkey LIMIT 10")
