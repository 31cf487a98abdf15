import pytest

from quarrylens.functions import text as T
from quarrylens.operators import graph, resolve

NODE = "uid string, kind string, name string, path string, line_start int, line_end int, lang string, status string, confidence double, payload string, seq int"


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(
        [
            ("file:a.py", "File", "a.py", "a.py", 0, 40, "python", "CONFIRMED", 1.0, "{}", 1),
            ("sym:a.py#A", "Symbol", "A", "a.py", 1, 30, "python", "CONFIRMED", 1.0, "{}", 1),
            ("sym:a.py#A.run", "Symbol", "run", "a.py", 5, 20, "python", "OBSERVED", 0.9, "{}", 1),
            ("sym:b.py#go", "Symbol", "go", "b.py", 1, 3, "python", "INFERRED", 0.5, "{}", 1),
            ("file:b.py", "File", "b.py", "b.py", 0, 3, "python", "CONFIRMED", 1.0, "{}", 1),
            ("sym:t/test_b.py#test_go", "Symbol", "test_go", "t/test_b.py", 1, 3, "python", "CONFIRMED", 1.0, "{}", 1),
        ],
        NODE,
    )


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, "CONFIRMED", c) for a, b, k, c in rows], "src string, dst string, kind string, status string, confidence double")


def test_upsert_keeps_latest_attributes_and_strongest_status(spark, nodes):
    again = spark.createDataFrame([("sym:b.py#go", "Symbol", "go2", "b.py", 2, 4, "python", "CONFIRMED", 0.4, "{}", 2), (None, "Symbol", "x", "x", 0, 0, None, None, 1.0, None, 1)], NODE)
    row = graph.upsert_nodes(nodes.unionByName(again), "seq").where("uid = 'sym:b.py#go'").first()
    assert (row["name"], row.status, row.confidence) == ("go2", "INFERRED", 0.5)
    assert row.tokens >= 1


def test_edges_need_both_ends_and_loops_are_calls(spark, nodes):
    staged = edges(spark, [("sym:a.py#A", "sym:b.py#go", "CALLS", 0.4), ("sym:a.py#A", "sym:b.py#go", "CALLS", 0.9), ("sym:a.py#A", "nowhere", "CALLS", 1.0), ("sym:a.py#A", "sym:a.py#A", "READS", 1.0), ("sym:a.py#A", "sym:a.py#A", "CALLS", 1.0)])
    kept = graph.upsert_edges(staged, nodes, "confidence").collect()
    assert {(r.src, r.dst, r.kind, r.confidence) for r in kept} == {("sym:a.py#A", "sym:b.py#go", "CALLS", 0.9), ("sym:a.py#A", "sym:a.py#A", "CALLS", 1.0)}
    assert [r.dst for r in graph.unresolved_edges(staged, nodes).collect()] == ["nowhere"]


def test_innermost_and_nesting(spark, nodes):
    points = spark.createDataFrame([("a.py", 6), ("a.py", 25), ("a.py", 35), ("b.py", 2)], "path string, line int")
    got = {(r.path, r.line): r.uid for r in graph.innermost(nodes.where("kind = 'Symbol'"), points).collect()}
    assert got == {("a.py", 6): "sym:a.py#A.run", ("a.py", 25): "sym:a.py#A", ("b.py", 2): "sym:b.py#go"}
    assert [tuple(r) for r in graph.nesting(nodes).collect()] == [("sym:a.py#A", "sym:a.py#A.run")]


def test_spread_takes_the_best_way_in_synchronous_rounds(spark):
    e = edges(spark, [("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 1.0), ("a", "c", "READS", 0.1), ("c", "d", "CALLS", 1.0), ("a", "e", "CO_CHANGES_WITH", 1.0)])
    got = {r.uid: round(r.score, 4) for r in graph.spread(e, spark.createDataFrame([("a", 1.0)], "uid string, score double")).collect()}
    assert got == {"a": 1.0, "b": 0.75, "c": round(0.75 * 0.75 * 0.55, 4), "d": round(0.065 * 0.75 * 0.55, 4)}


def test_impact_goes_two_calls_back_and_reports_shared_tables(spark):
    e = edges(spark, [("b", "a", "CALLS", 0.9), ("c", "b", "CALLS", 0.5), ("d", "c", "CALLS", 1.0), ("a", "db:t", "WRITES", 0.8), ("r", "db:t", "READS", 0.8), ("x", "r", "CALLS", 1.0)])
    got = {r.uid: (r.distance, r.how) for r in graph.impact(e, spark.createDataFrame([("a",)], "uid string")).collect()}
    assert got == {"b": (1, "calls"), "c": (2, "calls"), "r": (1, "data")}


def test_flow_starts_where_nothing_calls(spark):
    e = edges(spark, [("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 1.0), ("z", "a", "CALLS", 1.0)])
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    assert [r.uid for r in graph.entry_points(e, members).collect()] == ["a"]
    assert [(r.level, r.uid) for r in graph.flow(e, members).collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_coverage_counts_entries_from_other_files(spark, nodes):
    rows = {r.lang: (r.files, r.covered) for r in graph.coverage_by_language(nodes, edges(spark, [("sym:a.py#A", "sym:b.py#go", "CALLS", 1.0)])).collect()}
    assert rows == {"python": (2, 1), "TOTAL": (2, 1)}


def test_references_prefer_their_own_file(spark):
    symbols = spark.createDataFrame([("go", "a.ts", "s1", "typescript"), ("go", "b.js", "s2", "javascript"), ("one", "c.py", "s3", "python"), *[("many", f"{i}.py", f"m{i}", "python") for i in range(6)]], "name string, path string, uid string, lang string")
    refs = spark.createDataFrame([("f", "go", "a.ts", "typescript", "CALLS"), ("g", "go", "z.js", "javascript", "CALLS"), ("h", "one", "z.py", "python", "CALLS"), ("i", "many", "z.py", "python", "CALLS"), ("j", "many", "0.py", "python", "CALLS")], "from_uid string, name string, path string, lang string, kind string")
    got = {(r.from_uid, r.uid): round(r.confidence, 2) for r in resolve.resolve_references(refs, symbols).collect()}
    assert got == {("f", "s1"): 0.95, ("g", "s1"): 0.5, ("g", "s2"): 0.5, ("h", "s3"): 0.9, ("j", "m0"): 0.95}
    tested = resolve.tested_by(spark.createDataFrame([("sym:t", "sym:p", "CALLS", 0.9)], "from_uid string, uid string, kind string, confidence double"), spark.createDataFrame([("sym:t", "tests/test_a.py"), ("sym:p", "a.py")], "uid string, path string"), T.is_test_path)
    assert [(r.src, r.dst) for r in tested.collect()] == [("sym:p", "sym:t")]


def test_modules_become_files(spark):
    files = spark.createDataFrame([("app/order.py",), ("web/x/index.ts",), ("web/y.ts",), ("pkg/__init__.py",)], "path string")
    imports = spark.createDataFrame([("app/batch.py", "app.order"), ("web/y.ts", "./x"), ("web/x/index.ts", "web/y"), ("m.py", "pkg"), ("m.py", "missing")], "path string, module string")
    assert {(r.path, r.target) for r in resolve.module_edges(imports, files).collect()} == {("app/batch.py", "app/order.py"), ("web/y.ts", "web/x/index.ts"), ("web/x/index.ts", "web/y.ts"), ("m.py", "pkg/__init__.py")}
