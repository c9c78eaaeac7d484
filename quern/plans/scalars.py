"""Queries over the scalar, date, JSON and vector functions."""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str, str | None]] = {
    "q_str_funcs": ("part", "SELECT p_partkey, LENGTH(p_name) AS len, UPPER(p_name) AS up, LOWER(p_brand) AS low, REPLACE(p_type, 'A', 'aa') AS rep, INSTR(p_name, 'e') AS at, TRIM('  ' || p_name || char(9)) AS trimmed, LTRIM('  x ') AS l, RTRIM(' x  ') AS r FROM part", "SELECT p_partkey, length(p_name) AS len, upper(p_name) AS up, lower(p_brand) AS low, replace(p_type, 'A', 'aa') AS rep, instr(p_name, 'e') AS at, p_name AS trimmed, 'x ' AS l, ' x' AS r FROM part"),
    "q_substr_edges": ("part", "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTR(p_name, -3) AS b, SUBSTR(p_name, 0, 3) AS c, SUBSTR(p_name, 3, -1) AS d, SUBSTRING(p_name, 100) AS e FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 3) AS b, substr(p_name, 1, 2) AS c, substr(p_name, 3) AS d, substr(p_name, 100) AS e FROM part"),
    "q_hex_quote_unicode": ("nation", "SELECT n_name, HEX(n_name) AS h, HEX(n_nationkey) AS hn, QUOTE(n_name || '''s') AS q, UNICODE(n_name) AS u, UNICODE('') AS none, CHAR(8364, 97) AS c, HEX(ZEROBLOB(3)) AS z, TYPEOF(n_name) AS t, TYPEOF(n_nationkey) AS ti, TYPEOF(NULL) AS tn, TYPEOF(1.5) AS tr FROM nation", "SELECT n_name, hex(n_name) AS h, hex(CAST(n_nationkey AS VARCHAR)) AS hn, '''' || n_name || '''''s''' AS q, CAST(unicode(n_name) AS BIGINT) AS u, CAST(NULL AS BIGINT) AS none, '€a' AS c, '000000' AS z, 'text' AS t, 'integer' AS ti, 'null' AS tn, 'real' AS tr FROM nation"),
    "q_printf": ("lineitem", "SELECT l_orderkey, l_linenumber, PRINTF('%d/%i %s %f %%', l_orderkey, l_quantity, l_returnflag, l_discount) AS p FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey || '/' || CAST(l_quantity AS BIGINT) || ' ' || l_returnflag || ' ' || printf('%.6f', l_discount) || ' %' AS p FROM lineitem"),
    "q_math_round": ("lineitem", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice / 7, 2) AS r2, ROUND(l_quantity / 4) AS r0, ROUND(1.005, 2) AS half, ABS(l_discount - 0.05) AS a, SIGN(l_quantity - 25) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7 * 100) / 100 AS r2, round(l_quantity / 4) AS r0, CAST(1.0 AS DOUBLE) AS half, abs(l_discount - 0.05) AS a, CAST(sign(l_quantity - 25) AS BIGINT) AS s FROM lineitem"),
    "q_minmax_scalar": ("part", "SELECT p_partkey, MIN(p_size, 20, p_partkey) AS lo, MAX(p_size, 20) AS hi, MIN(p_size, NULL) AS none, MAX(NULL, p_size) AS lead FROM part", "SELECT p_partkey, least(p_size, 20, p_partkey) AS lo, CAST(greatest(p_size, 20) AS BIGINT) AS hi, CAST(NULL AS INTEGER) AS none, p_size AS lead FROM part"),
    "q_coalesce_nullif": ("part", "SELECT p_partkey, COALESCE(NULLIF(p_size, 5), -1) AS c, IFNULL(NULL, p_name) AS i, NULLIF(p_brand, 'Brand#11') AS n, LIKELY(p_size) AS k FROM part", "SELECT p_partkey, CAST(coalesce(nullif(p_size, 5), -1) AS BIGINT) AS c, p_name AS i, nullif(p_brand, 'Brand#11') AS n, p_size AS k FROM part"),
    "q_cast_rules": ("part", "SELECT p_partkey, CAST(p_name AS INTEGER) AS zero, CAST('  12 ' AS INT) AS twelve, CAST('12abc' AS INT) AS bad, CAST(p_retailprice AS INTEGER) AS whole, CAST(p_size AS TEXT) AS t, CAST('3.5' AS REAL) AS r, CAST(2.0 AS TEXT) AS two FROM part", "SELECT p_partkey, CAST(0 AS BIGINT) AS zero, CAST(12 AS BIGINT) AS twelve, CAST(0 AS BIGINT) AS bad, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS VARCHAR) AS t, CAST(3.5 AS DOUBLE) AS r, '2' AS two FROM part"),
    "q_date_mods": ("orders", "SELECT o_orderkey, DATE(o_orderdate) AS d, DATETIME(o_orderdate, '+36 hours') AS t, DATE(o_orderdate, 'start of month', '+1 month', '-1 day') AS last_day, DATE(o_orderdate, '+1 month') AS next, TIME(o_orderdate, '+90 seconds') AS clock, DATE('2024-01-31', '+1 month') AS clamp, DATE('2024-13-01') AS bad FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS t, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next, strftime(o_orderdate + INTERVAL 90 SECOND, '%H:%M:%S') AS clock, '2024-02-29' AS clamp, CAST(NULL AS VARCHAR) AS bad FROM orders"),
    "q_strftime": ("events", "SELECT event_id, STRFTIME('%Y/%m/%d %H-%M-%S %j %w %f %%', ts) AS f, STRFTIME('%s', ts) AS s, STRFTIME('%W', ts) AS w FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S %j %w %S') || '.000 %' AS f, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS s, lpad(CAST((dayofyear(ts) + 6 - dayofweek(ts)) // 7 AS VARCHAR), 2, '0') AS w FROM events"),
    "q_julian_unix": ("orders", "SELECT o_orderkey, JULIANDAY(o_orderdate) AS j, UNIXEPOCH(o_orderdate) AS u, DATETIME(UNIXEPOCH(o_orderdate)) AS back, JULIANDAY('2024-03-15') AS fixed FROM orders", "SELECT o_orderkey, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j, CAST(epoch(o_orderdate) AS BIGINT) AS u, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS back, CAST(2460384.5 AS DOUBLE) AS fixed FROM orders"),
    "q_json_extract": ("events", "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS INTEGER) AS k, props ->> 'k' AS t, JSON_EXTRACT(props, '$.missing') AS none FROM events WHERE JSON_EXTRACT(props, '$.k') > 50", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, props ->> '$.k' AS t, CAST(NULL AS VARCHAR) AS none FROM events WHERE CAST(props ->> '$.k' AS BIGINT) > 50"),
    "q_json_type_valid": ("events", "SELECT event_id, JSON_TYPE(props) AS t, JSON_TYPE(props, '$.k') AS tk, JSON_VALID(props) AS v, JSON_VALID('no' || props) AS bad, JSON_ARRAY_LENGTH('[1,2,3]') AS n, JSON_ARRAY_LENGTH(props) AS zero FROM events", "SELECT event_id, 'object' AS t, 'real' AS tk, CAST(1 AS BIGINT) AS v, CAST(0 AS BIGINT) AS bad, CAST(3 AS BIGINT) AS n, CAST(0 AS BIGINT) AS zero FROM events"),
    "q_json_build": ("nation", "SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL, '[1]') AS a, JSON_OBJECT('name', n_name, 'key', n_nationkey) AS o, JSON_QUOTE(n_name) AS q, JSON('{ \"a\" : [ 1.0, 2 ] }') AS m FROM nation", "SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",null,[1]]' AS a, '{\"name\":\"' || n_name || '\",\"key\":' || n_nationkey || '}' AS o, '\"' || n_name || '\"' AS q, '{\"a\":[1,2]}' AS m FROM nation"),
    "q_json_set_remove_patch": ("events", "SELECT event_id, JSON_SET(props, '$.n', event_id) AS s, JSON_INSERT(props, '$.k', 0) AS i, JSON_REPLACE(props, '$.k', 'x') AS r, JSON_REMOVE(props, '$.k') AS d, JSON_PATCH(props, '{\"k\":null,\"z\":1}') AS p FROM events", "SELECT event_id, '{\"k\":' || (props ->> '$.k') || ',\"n\":' || event_id || '}' AS s, '{\"k\":' || (props ->> '$.k') || '}' AS i, '{\"k\":\"x\"}' AS r, '{}' AS d, '{\"z\":1}' AS p FROM events"),
    "q_json_each": ("region", "SELECT key, value, type, fullkey FROM json_each('{\"a\":1,\"b\":[2,3],\"c\":\"x\"}')", "SELECT * FROM (VALUES ('a', '1', 'real', '$.a'), ('b', '[2,3]', 'array', '$.b'), ('c', 'x', 'text', '$.c')) AS t(key, value, type, fullkey)"),
    "q_json_tree": ("region", "SELECT id, parent, key, type, fullkey, path FROM json_tree('{\"a\":[1,2],\"b\":{\"c\":3}}')", "SELECT CAST(id AS BIGINT) AS id, CAST(parent AS BIGINT) AS parent, key, type, fullkey, path FROM (VALUES (0, NULL, NULL, 'object', '$', '$'), (1, NULL, 'a', 'array', '$.a', '$'), (2, 1, '0', 'real', '$.a[0]', '$.a'), (3, 1, '1', 'real', '$.a[1]', '$.a'), (4, NULL, 'b', 'object', '$.b', '$'), (5, 4, 'c', 'real', '$.b.c', '$.b')) AS t(id, parent, key, type, fullkey, path)"),
    "q_json_each_lateral": ("events", "SELECT e.event_id, j.key, CAST(j.value AS INTEGER) AS value FROM events e, json_each(e.props) j", "SELECT event_id, 'k' AS key, CAST(props ->> '$.k' AS BIGINT) AS value FROM events"),
    "q_vec_cosine_topk": ("embeddings", "SELECT vec_id, round(VEC_DISTANCE_COSINE(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10", "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10"),
    "q_vec_l2_topk": ("embeddings", "SELECT vec_id, round(VEC_DISTANCE_L2(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 11)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10", "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 11)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10"),
    "q_vec_dot_topk": ("embeddings", "SELECT vec_id, round(VEC_DISTANCE_DOT(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 3)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10", "SELECT vec_id, round(list_negative_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10"),
    "q_vec_normalize": ("embeddings", "SELECT vec_id, VEC_LENGTH(embedding) AS n, round(VEC_DISTANCE_DOT(VEC_NORMALIZE(embedding), VEC_NORMALIZE(embedding)), 4) AS unit, VEC_TO_JSON(VEC_FROM_JSON('[1,2.5]')) AS j FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(-1 AS DOUBLE) AS unit, '[1.0,2.5]' AS j FROM embeddings"),
    "q_json_quote_controls": ("nation", "SELECT n_nationkey, JSON_QUOTE(CHAR(n_nationkey + 1)) AS q, JSON_VALID(JSON_ARRAY(CHAR(n_nationkey + 1), n_name)) AS v, JSON_EXTRACT(JSON_OBJECT('k', CHAR(n_nationkey + 1) || 'x'), '$.k') AS back FROM nation", "SELECT n_nationkey, CAST(to_json(chr(n_nationkey + 1)) AS VARCHAR) AS q, CAST(1 AS BIGINT) AS v, chr(n_nationkey + 1) || 'x' AS back FROM nation"),
    "q_json_arrows": ("events", "SELECT event_id, props -> '$.k' AS a, JSON_EXTRACT(props, '$.k', '$.none') AS b FROM events", "SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS a, '[' || (props ->> '$.k') || ',null]' AS b FROM events"),
    "q_cast_saturates": ("lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * 1e30 AS INTEGER) AS big, CAST(-l_extendedprice * 1e30 AS INTEGER) AS small, CAST(CAST(' 42 ' AS BLOB) AS INTEGER) AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(9223372036854775807 AS BIGINT) AS big, CAST(-9223372036854775808 AS BIGINT) AS small, CAST(42 AS BIGINT) AS b FROM lineitem"),
    "q_like_column": ("part", "SELECT p_partkey, p_name LIKE UPPER(SUBSTR(p_name, 1, 3)) || '%' AS a, 'É' LIKE LOWER('É') || SUBSTR(p_name, 1, 0) AS b, p_name ILIKE '%GREEN%' AS c FROM part", "SELECT p_partkey, CAST(1 AS BIGINT) AS a, CAST(lower('É') = 'É' AS BIGINT) AS b, CAST(p_name ILIKE '%GREEN%' AS BIGINT) AS c FROM part"),
    "q_is_true_functions": ("orders", "SELECT o_orderkey, IS_TRUE(o_custkey % 2) AS a, IS_FALSE(o_custkey % 2) AS b, IS_NOT_TRUE(NULLIF(o_custkey % 3, 0)) AS c, IS_NOT_FALSE(NULLIF(o_custkey % 3, 0)) AS d FROM orders", "SELECT o_orderkey, CAST(o_custkey % 2 <> 0 AS BIGINT) AS a, CAST(o_custkey % 2 = 0 AS BIGINT) AS b, CAST(o_custkey % 3 = 0 AS BIGINT) AS c, CAST(1 AS BIGINT) AS d FROM orders"),
    "q_random_shapes": ("orders", "SELECT o_orderkey, TYPEOF(RANDOM()) AS a, LENGTH(RANDOMBLOB(8)) AS n, TYPEOF(SQLITE_VERSION()) AS v FROM orders", "SELECT o_orderkey, 'integer' AS a, CAST(8 AS BIGINT) AS n, 'text' AS v FROM orders"),
    "q_fts_match_words": ("nation", "SELECT n_nationkey, FTS5_MATCH('Café au lait ' || n_name, 'cafe') AS accents, FTS5_MATCH('I don''t know foo_bar 3.14 ' || n_name, 'dont foobar 314') AS joined, FTS5_MATCH('I don''t ' || n_name, 'don') AS part, FTS5_MATCH('東京都 ' || n_name, '京') AS ideograph, FTS5_RANK('a b ' || n_name, n_name || ' zz') AS share FROM nation", "SELECT n_nationkey, CAST(1 AS BIGINT) AS accents, CAST(1 AS BIGINT) AS joined, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS ideograph, len(string_split(n_name, ' ')) / (len(string_split(n_name, ' ')) + 1)::DOUBLE AS share FROM nation"),
    "q_fts_rank_ratio": ("documents", "SELECT doc_id, FTS5_MATCH(text, 'the and') AS m, FTS5_RANK(text, 'the xyzzy') AS r FROM documents", "SELECT doc_id, CAST(list_contains(w, 'the') AND list_contains(w, 'and') AS BIGINT) AS m, CASE WHEN list_contains(w, 'the') THEN 0.5 ELSE 0.0 END::DOUBLE AS r FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(strip_accents(text)), $$(?:\\p{L}(?:[:.'’·]\\p{L})*|\\p{N}(?:[,;.'’]\\p{N})*|_)+$$), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) AS w FROM documents)"),
}
