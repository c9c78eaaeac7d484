"""Queries over the relational operators: (tables, the dialect's SQL, SQL for DuckDB or None if it is the same)."""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str, str | None]] = {
    "q_single_row": ("region", "SELECT 1 AS one, 'x' AS x", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x"),
    "q_scan_project": ("part", "SELECT p_partkey, p_name, p_retailprice * 2 AS double_price FROM part WHERE p_size <= 10", None),
    "q_star": ("nation", "SELECT * FROM nation", None),
    "q_table_star": ("nation region", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'", None),
    "q_index_equality_scan": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37 AND o_orderstatus = 'O'", None),
    "q_index_range_scan": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 100 AND l_orderkey <= 500", None),
    "q_filter_predicates": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000 AND NOT (o_orderstatus = 'F') AND o_custkey IS NOT NULL OR o_orderkey < 20", None),
    "q_not_between": ("part", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", None),
    "q_is_distinct": ("events", "SELECT event_id, nullif(user_id, 3) IS NOT NULL AS known, nullif(user_id, 3) IS NOT DISTINCT FROM NULL AS same, nullif(user_id, 3) IS 4 AS four FROM events", "SELECT event_id, CAST(nullif(user_id, 3) IS NOT NULL AS BIGINT) AS known, CAST(nullif(user_id, 3) IS NOT DISTINCT FROM NULL AS BIGINT) AS same, CAST(nullif(user_id, 3) IS NOT DISTINCT FROM 4 AS BIGINT) AS four FROM events"),
    "q_is_true": ("part", "SELECT p_partkey, p_size > 20 IS TRUE AS a, (p_size % 2) IS NOT TRUE AS b, nullif(p_size, 1) IS FALSE AS c FROM part", "SELECT p_partkey, CAST(p_size > 20 AS BIGINT) AS a, CAST(p_size % 2 = 0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM part"),
    "q_in_not_in_nulls": ("nation", "SELECT n_nationkey, n_nationkey IN (1, 2, NULL) AS a, n_nationkey NOT IN (1, NULL) AS b FROM nation", "SELECT n_nationkey, CAST(n_nationkey IN (1, 2) AS BIGINT) AS a, CAST(n_nationkey NOT IN (1) AS BIGINT) AS b FROM nation"),
    "q_like_nocase": ("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A%e%' AND p_type NOT LIKE 'STANDARD%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%e%' AND p_type NOT ILIKE 'STANDARD%'"),
    "q_like_escape": ("part", "SELECT p_partkey, 'a_' || p_brand LIKE 'a!_brand%' ESCAPE '!' AS hit FROM part", "SELECT p_partkey, CAST('a_' || p_brand ILIKE 'a!_brand%' ESCAPE '!' AS BIGINT) AS hit FROM part"),
    "q_glob": ("part", "SELECT p_partkey FROM part WHERE GLOB('*[a-m]?', p_name) AND p_brand GLOB 'Brand#[^1-3]*'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(?s).*[a-m].') AND regexp_full_match(p_brand, 'Brand#[^1-3].*')"),
    "q_case_iif": ("part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS size_class, CASE p_size WHEN 1 THEN 'one' WHEN NULL THEN 'none' END AS named, IIF(p_size % 2, 'odd', 'even') AS parity FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS size_class, CASE p_size WHEN 1 THEN 'one' END AS named, CASE WHEN p_size % 2 <> 0 THEN 'odd' ELSE 'even' END AS parity FROM part"),
    "q_collate_nocase": ("nation", "SELECT n_name FROM nation WHERE n_name = 'fRaNcE' COLLATE NOCASE OR n_name COLLATE NOCASE IN ('GERMANY', 'japan')", "SELECT n_name FROM nation WHERE lower(n_name) IN ('france', 'germany', 'japan')"),
    "q_cross_type_compare": ("nation", "SELECT n_nationkey, n_nationkey < 'a' AS lt, n_nationkey = '1' AS eq, 'a' >= 5 AS ge FROM nation", "SELECT n_nationkey, CAST(1 AS BIGINT) AS lt, CAST(0 AS BIGINT) AS eq, CAST(1 AS BIGINT) AS ge FROM nation"),
    "q_concat_numbers": ("part", "SELECT p_partkey, p_name || '-' || p_size || '/' || 1.0 || '/' || 2.5 AS label FROM part", "SELECT p_partkey, p_name || '-' || p_size || '/1/2.5' AS label FROM part"),
    "q_arithmetic": ("lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS s, l_orderkey - 5 AS d, l_linenumber * 3 AS m, -l_linenumber AS neg, l_quantity + 1 AS q, 'text' + 5 AS t FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS s, l_orderkey - 5 AS d, CAST(l_linenumber * 3 AS BIGINT) AS m, -l_linenumber AS neg, l_quantity + 1 AS q, CAST(5 AS BIGINT) AS t FROM lineitem"),
    "q_int_div_zero": ("lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS d, l_orderkey / (l_linenumber - 1) AS z, l_orderkey % (l_linenumber - 1) AS m, -7 / 2 AS n, -7 % 3 AS r, 7.5 / 2 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS d, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey // (l_linenumber - 1) END AS z, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey % (l_linenumber - 1) END AS m, CAST(-3 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS r, CAST(3.75 AS DOUBLE) AS f FROM lineitem"),
    "q_bit_ops": ("orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, ~o_orderkey AS n, -8 >> 1 AS u FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, ~o_orderkey AS n, CAST(9223372036854775804 AS BIGINT) AS u FROM orders"),
    "q_join_inner": ("customer nation", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", None),
    "q_join_left": ("customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", None),
    "q_join_right": ("orders customer", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "q_join_full": ("supplier nation", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 12) s FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 5) n ON s_nationkey = n_nationkey", None),
    "q_join_cross": ("region nation", "SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 4", None),
    "q_join_using": ("nation", "SELECT a.n_name AS x, b.k FROM nation a JOIN (SELECT n_nationkey, n_regionkey * 10 AS k FROM nation) b USING (n_nationkey)", "SELECT a.n_name AS x, CAST(b.k AS BIGINT) AS k FROM nation a JOIN (SELECT n_nationkey, n_regionkey * 10 AS k FROM nation) b USING (n_nationkey)"),
    "q_join_natural": ("nation", "SELECT n_name, k FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey + 1 AS k FROM nation) b", "SELECT n_name, CAST(k AS BIGINT) AS k FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey + 1 AS k FROM nation) b"),
    "q_join_natural_left": ("nation", "SELECT n_name, k FROM nation NATURAL LEFT JOIN (SELECT n_nationkey, n_regionkey + 1 AS k FROM nation WHERE n_nationkey < 9) b", "SELECT n_name, CAST(k AS BIGINT) AS k FROM nation NATURAL LEFT JOIN (SELECT n_nationkey, n_regionkey + 1 AS k FROM nation WHERE n_nationkey < 9) b"),
    "q_join_theta": ("nation", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey", None),
    "q_join_self": ("nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "q_semi_in": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", None),
    "q_anti_not_in": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 4) FROM orders)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey <> 4)"),
    "q_exists": ("region nation", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 300)", None),
    "q_agg_basic": ("lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS n_tax, SUM(l_linenumber) AS s, round(AVG(l_quantity), 4) AS a, MIN(l_extendedprice) AS lo, MAX(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS n_tax, CAST(SUM(l_linenumber) AS BIGINT) AS s, round(AVG(l_quantity), 4) AS a, MIN(l_extendedprice) AS lo, MAX(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "q_agg_distinct": ("lineitem", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "q_agg_filter": ("events", "SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 50) AS high, SUM(user_id) FILTER (WHERE user_id % 2 = 0) AS even FROM events GROUP BY event_type", "SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 50) AS high, CAST(SUM(user_id) FILTER (WHERE user_id % 2 = 0) AS BIGINT) AS even FROM events GROUP BY event_type"),
    "q_agg_total_empty": ("events", "SELECT TOTAL(value) AS t, SUM(value) AS s, COUNT(value) AS n, MAX(value) AS m, AVG(value) AS a FROM events WHERE event_id < 0", "SELECT CAST(0 AS DOUBLE) AS t, SUM(value) AS s, COUNT(value) AS n, MAX(value) AS m, AVG(value) AS a FROM events WHERE event_id < 0"),
    "q_having": ("orders", "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_totalprice) < 50000", None),
    "q_group_ordinal_expression": ("orders", "SELECT o_orderkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY 1", None),
    "q_group_concat": ("nation", "SELECT n_regionkey, GROUP_CONCAT(n_name, '; ' ORDER BY n_nationkey) AS names, GROUP_CONCAT(DISTINCT n_regionkey) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names, CAST(n_regionkey AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey"),
    "q_json_group_array": ("nation", "SELECT n_regionkey, JSON_GROUP_ARRAY(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names FROM nation GROUP BY n_regionkey"),
    "q_json_group_object": ("nation", "SELECT n_regionkey, JSON_GROUP_OBJECT(n_name, n_nationkey ORDER BY n_nationkey) AS entries FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS entries FROM nation GROUP BY n_regionkey"),
    "q_agg_in_case": ("orders", "SELECT o_orderstatus, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS size, CAST(AVG(o_custkey) AS INTEGER) AS mid FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS size, CAST(floor(AVG(o_custkey)) AS BIGINT) AS mid FROM orders GROUP BY o_orderstatus"),
    "q_win_rank_family": ("orders", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr FROM orders", None),
    "q_win_ntile_parity": ("orders", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bucket FROM orders", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 4 // count(*) OVER (PARTITION BY o_custkey) + 1 AS bucket FROM orders"),
    "q_win_lag_lead": ("orders", "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM orders", None),
    "q_win_first_last_nth": ("orders", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "q_win_percent_cume": ("orders", "SELECT o_orderkey, round(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey), 9) AS p, round(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey), 9) AS c FROM orders", None),
    "q_win_frames_rows": ("orders", "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, COUNT(*) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS 3 PRECEDING) AS n, MIN(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS 3 PRECEDING) AS n, MIN(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM orders"),
    "q_win_default_peers": ("orders", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS running, MAX(o_orderkey) OVER (PARTITION BY o_orderstatus) AS top FROM orders", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS running, MAX(o_orderkey) OVER (PARTITION BY o_orderstatus) AS top FROM orders"),
    "q_win_range_current": ("orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM orders", None),
    "q_win_groups_sql": ("orders", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS CURRENT ROW) AS peers FROM orders", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS BIGINT) AS before, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN CURRENT ROW AND CURRENT ROW) AS peers FROM orders"),
    "q_win_filter": ("events", "SELECT event_id, COUNT(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS high FROM events", None),
    "q_win_named": ("orders", "SELECT o_orderkey, ROW_NUMBER() OVER w2 AS rn, COUNT(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey), w2 AS (w ORDER BY o_orderkey DESC)", None),
    "q_win_over_aggregate": ("orders", "SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS place FROM orders GROUP BY o_custkey", None),
    "q_order_nulls": ("orders", "SELECT o_orderkey, nullif(o_custkey % 7, 3) AS k FROM orders ORDER BY k, o_orderkey", "SELECT o_orderkey, nullif(o_custkey % 7, 3) AS k FROM orders ORDER BY k NULLS FIRST, o_orderkey"),
    "q_order_limit_offset": ("orders", "SELECT o_orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 25 OFFSET 10", None),
    "q_order_unprojected": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 40", None),
    "q_distinct": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "q_union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "q_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k LIMIT 10", "SELECT * FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY k LIMIT 10"),
    "q_intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "q_intersect_all_semi": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "q_except": ("nation supplier", "SELECT n_regionkey * 10 + n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", "SELECT CAST(n_regionkey * 10 + n_nationkey AS BIGINT) AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier"),
    "q_except_all_anti": ("customer orders", "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "q_values": ("region", "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v", "SELECT CAST(col0 AS BIGINT) AS a, col1 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v"),
    "q_cte_chain": ("orders customer", "WITH big(k, price) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT k, COUNT(*) AS n, MAX(price) AS top FROM big GROUP BY k) SELECT c_name, n, top FROM per JOIN customer ON k = c_custkey WHERE n > 1", None),
    "q_recursive_count": ("region", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 200) SELECT x, x * x AS square FROM c", "WITH RECURSIVE c(x) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT x + 1 FROM c WHERE x < 200) SELECT x, x * x AS square FROM c"),
    "q_recursive_fib": ("region", "WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0, 1 UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60) SELECT n, a FROM f", "WITH RECURSIVE f(n, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60) SELECT n, a FROM f"),
    "q_recursive_hierarchy": ("nation", "WITH RECURSIVE tree(id, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, depth + 1 FROM nation n JOIN tree t ON (n.n_nationkey - 1) / 2 = t.id WHERE n.n_nationkey > 0) SELECT id, depth FROM tree", "WITH RECURSIVE tree(id, depth) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT) FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, depth + 1 FROM nation n JOIN tree t ON (n.n_nationkey - 1) // 2 = t.id WHERE n.n_nationkey > 0) SELECT id, depth FROM tree"),
    "q_recursive_union_distinct": ("region", "WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT (x * 3) % 17 FROM c) SELECT x FROM c", "WITH RECURSIVE c(x) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (x * 3) % 17 FROM c) SELECT x FROM c"),
    "q_subq_scalar": ("orders", "SELECT o_orderkey, o_totalprice - (SELECT MIN(o_totalprice) FROM orders) AS above, (SELECT o_custkey FROM orders WHERE o_orderkey < 0) AS none FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "q_subq_correlated": ("customer orders", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "q_derived_table": ("orders", "SELECT s, MAX(n) AS most FROM (SELECT o_custkey, o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) d GROUP BY s", None),
    "q_series": ("region", "SELECT value FROM generate_series(1, 100, 7)", "SELECT generate_series AS value FROM generate_series(1, 100, 7)"),
}
