"""Pieces of the engine that need little or no Spark."""

from __future__ import annotations

import fnmatch
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.dialect.parser import SqlError, parse, parse_expr, split_statements, tokenize
from quern.functions import json_values
from quern.functions.glob import glob_match
from quern.operators import fts, knn, spatial, window
from quern.operators.recursive import recursive_union


def test_literals_and_comments_hide_nothing():
    assert split_statements("SELECT ';' -- ; \n; /* ; */ SELECT 2") == ["SELECT ';' -- ;", "/* ; */ SELECT 2"]
    assert split_statements("CREATE TRIGGER t AFTER INSERT ON a BEGIN SELECT CASE WHEN 1 THEN 2 END; END; SELECT 1")[1] == "SELECT 1"
    assert parse_expr("'it''s'").value == "it's" and parse_expr('"a""b"').name == 'a"b' and parse_expr("[x y]").name == "x y"
    with pytest.raises(SqlError):
        tokenize("SELECT #")


def test_precedence():
    shape = lambda n: n.value if n.kind == "literal" else (n.op, *[shape(x) for x in ([n.left, n.right] if n.kind == "binary" else [n.arg])])
    assert shape(parse_expr("1 + 2 * 3 = 7 AND NOT 0 OR 1")) == ("OR", ("AND", ("=", ("+", 1, ("*", 2, 3)), 7), ("NOT", 0)), 1)
    assert shape(parse_expr("1 < 2 = 1")) == ("=", ("<", 1, 2), 1) and shape(parse_expr("-1 || 2")) == ("||", ("-", 1), 2)
    assert shape(parse_expr("1 << 2 + 3 & 4")) == ("&", ("<<", 1, ("+", 2, 3)), 4)


def test_parameters_are_numbered():
    q = parse("SELECT ?, ?5, ?, :name")
    assert [i.arg.index for i in q.body.items] == [0, 4, 5, 6]


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?", max_size=8), st.text("ab*?c", max_size=8))
def test_glob_is_fnmatch_without_classes(pattern, value):
    assert glob_match(pattern, value) == fnmatch.fnmatchcase(value, pattern)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text("ab\"\\é", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_json_round_trip(value):
    text = json_values.minify(json.dumps(value))
    assert json.loads(text) == value and json_values.minify(text) == text
    tree = json_values.tree(text)
    assert all(json_values.dump(json_values.find(value, json_values.steps(r[6]))) == (r[1] if r[2] in ("array", "object") else json_values.dump(json_values.find(value, json_values.steps(r[6])))) for r in tree)


@settings(max_examples=100, deadline=None)
@given(JSON, JSON)
def test_json_patch_rules(target, change):
    got = json.loads(json_values.patch(json.dumps(target), json.dumps(change)))
    assert got == change if not isinstance(change, dict) else all(k not in got for k, v in change.items() if v is None)


def test_overlap_join_is_brute_force(spark):
    rng = random.Random(3)
    box = lambda i: (i, x := rng.uniform(0, 100), x + rng.choice([0.0, 1.0, 5.0, 80.0]) * rng.random(), y := rng.uniform(0, 100), y + rng.choice([0.0, 2.0, 90.0]) * rng.random())
    left, right = [box(i) for i in range(150)], [box(i) for i in range(150)]
    schema = "double, ".join(["min_0 ", "max_0 ", "min_1 ", "max_1 "]) + "double"
    a, b = spark.createDataFrame(left, f"a long, {schema}"), spark.createDataFrame(right, f"b long, {schema}")
    got = sorted(map(tuple, spatial.overlap_join(a, b, "a", "b", ["min_0", "min_1"], ["max_0", "max_1"]).collect()))
    want = sorted((p[0], q[0]) for p in left for q in right if p[2] >= q[1] and p[1] <= q[2] and p[4] >= q[3] and p[3] <= q[4])
    assert got == want


@pytest.mark.parametrize("crowd", [(300, 20), (20, 300), (300, 300)])
def test_overlap_join_splits_hot_cells(spark, crowd):
    rng = random.Random(5)
    box = lambda i, k: (i, x := rng.uniform(50, 50.5) if i < k else rng.uniform(0, 100), x + rng.random() / 4, y := rng.uniform(50, 50.5) if i < k else rng.uniform(0, 100), y + rng.random() / 4)
    left, right = ([box(i, k) for i in range(k + 60)] for k in crowd)
    schema, low, high = "min_0 double, max_0 double, min_1 double, max_1 double", ["min_0", "min_1"], ["max_0", "max_1"]
    a, b = spark.createDataFrame([*left, (None, *left[0][1:]), (-1, None, 1.0, 1.0, None)], f"a long, {schema}"), spark.createDataFrame(right, f"b long, {schema}")
    meet = lambda p, q: p[2] >= q[1] and p[1] <= q[2] and p[4] >= q[3] and p[3] <= q[4]
    want = sorted([(p[0], q[0]) for p in left for q in right if meet(p, q)] + [(-9, q[0]) for q in right if meet(left[0], q)])
    for hot_rows in (8, 10_000):
        got = spatial.overlap_join(a, b, "a", "b", low, high, sizes=[2.0, 2.0], hot_rows=hot_rows).collect()
        assert sorted((-9 if r.a is None else r.a, r.b) for r in got) == want
    dealt = [df.withColumnRenamed("min_0", "c") for df in (a.selectExpr("a", "floor(min_0 / 2) AS min_0"), b.selectExpr("b", "floor(min_0 / 2) AS min_0"))]
    salts = [df.filter("c = 25").select("__a", "__b").distinct().count() for df in spatial.split_hot(*dealt, ["c"], 100)]
    assert all(n > spatial.SALTS / 2 for n in salts)


def test_ntile(spark):
    df = spark.range(10).withColumn("b", window.ntile(4, [], "id"))
    assert [r.n for r in df.groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect()] == [3, 2, 3, 2]


def test_groups_frames_to_the_end_are_running_ones(spark):
    for before, after in ((1, None), (-1, None), (None, None), (None, 1)):
        df = window.groups_frame(spark.range(12).selectExpr("id", "id % 2 AS p", "id DIV 4 AS k"), F.sum("id"), "s", ["p"], "k", before, after)
        within = lambda r, q: q % 2 == r % 2 and (before is None or q // 4 >= r // 4 - before) and (after is None or q // 4 <= r // 4 + after)  # noqa: B023, E731
        assert {r.id: r.s for r in df.collect()} == {i: sum(q for q in range(12) if within(i, q)) or None for i in range(12)}
        assert before is None or "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_recursive_union_ends_and_errs(spark):
    found = recursive_union(spark.range(1), lambda d: d.selectExpr("(id * 2 + 1) % 11 AS id"))
    assert sorted(r.id for r in found.collect()) == list(range(10))
    with pytest.raises(RuntimeError):
        recursive_union(spark.range(1), lambda d: d.selectExpr("id + 1 AS id"), rounds=3)


def test_nearest(spark):
    rows = [(i, [float(i % 7), float(i // 7), 1.0]) for i in range(49)] + [(99, None), (98, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [(r.id, r.distance) for r in knn.nearest(df, [2.0, 3.0, 1.0], 3, "id", "v", "l2").collect()]
    assert got == [(23, 0.0), (16, 1.0), (22, 1.0)]
    with pytest.raises(ValueError):
        knn.distance(F.col("v"), F.col("v"), "none")


def test_tokens(spark):
    texts = ["Hello, World! 2x", "Ünïcode CAFÉ ﬁne", "don't stop_now 4.5 1,000 a,b", "", None, "東京 x", "L’été a.b 3.14é"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", fts.tokens(F.col("t")).alias("t")).orderBy("k").collect()]
    assert got == [["hello", "world", "2x"], ["unicode", "cafe", "fine"], ["dont", "stopnow", "45", "1000", "a", "b"], [], None, ["東", "京", "x"], ["lete", "ab", "314e"]]
    assert fts.query_tokens("Ünï CAFÉ") == ["uni", "cafe"]
    with pytest.raises(SqlError):
        fts.parse(" ")


def test_nearest_batch_has_no_cap_of_queries(spark, monkeypatch):
    from quern.operators import knn

    v = spark.range(60).selectExpr("id", "array(cast(id * 7 % 31 as double), cast(id * id % 17 as double)) AS v")
    q = v.selectExpr("id AS q", "v AS w").filter("q % 2 = 0")
    run = lambda: sorted(map(tuple, knn.nearest_batch(v, q, 3, "id", "v", "q", "w", "l2").collect()))
    whole = run()
    assert len(whole) == 90
    monkeypatch.setattr(knn, "QUERY_LIMIT", 8)
    assert run() == whole


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_ivf_recall(spark, metric):
    from quern.operators import ivf

    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("w"))
    index = ivf.build(v, "vec_id", "embedding", metric)
    assert sum(index.sizes.values()) == v.count()
    got = {(r.query_id, r.id) for r in ivf.search(index, q, 10, "q", "w").collect()}
    exact = {(r.q, r.vec_id) for r in knn.nearest_batch(v, q, 10, "vec_id", "embedding", "q", "w", metric).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.95 * len(exact)


def test_ivf_of_clusters_asks_few_lists(spark, tmp_path):
    import numpy as np

    from quern.operators import ivf

    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 16))[rng.integers(30, size=1500)] * 4 + rng.normal(size=(1500, 16))
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, v array<double>")
    index = ivf.build(v, "id", "v", folder=f"file://{tmp_path}/lists")
    got = {(r.query_id, r.id) for r in ivf.search(index, v.filter("id % 50 = 0"), 10, "id", "v").collect()}
    true = {(q, int(k)) for q in range(0, 1500, 50) for k in np.argsort(((x - x[q]) ** 2).sum(axis=1))[:10]}
    assert index.probes < len(index.centroids) / 3 and len(got & true) >= 0.95 * len(true)


def test_ivf_of_odd_rows(spark, monkeypatch):
    from quern.operators import ivf

    rows = [(k, [1.0, 2.0]) for k in range(60)] + [(60, [9.0, 9.0]), (61, None), (62, [1.0]), (63, [9.0, None]), (None, [5.0, 5.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = spark.createDataFrame([(1, [9.0, 9.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0])], "q long, w array<double>")
    index = ivf.build(v, "id", "v", lists=4)
    expected = {1: [60, None, 0], 4: [0, 1, 2]}
    for limit, task in ((10_000, 200_000), (0, 7)):  # broadcast, and dealt to several tasks
        monkeypatch.setattr(ivf, "QUERY_LIMIT", limit)
        monkeypatch.setattr(ivf, "ROWS_A_TASK", task)
        got = {}
        for r in ivf.search(index, q, 3, "q", "w", probes=1).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == expected
    nothing = ivf.build(v.limit(0), "id", "v")
    assert ivf.search(nothing, q, 3, "q", "w").count() == 0
    with pytest.raises(ValueError):
        ivf.build(v, "id", "v", "dot")
