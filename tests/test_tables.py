"""Queries over small invented tables."""

from quarrylens.__main__ import _rows
from quarrylens.operators import rules
from quarrylens.plans import queries as core

ORDER = "class ParcelDesk:\n    def needs_approval(self):\n        if self.manager_orders and self.depot == 12:\n            return skip_approval\n        return True\n"
TEST = "def test_manager_orders_require_approval_first():\n    needs_approval()\n"
NODE = "node_id long, uid string, kind string, name string, path string, line_start int, line_end int, lang string, status string, confidence double, payload string"


def write_tables(spark, folder):
    """A file, its test and a section that contradicts the file."""
    sym = lambda i, path, name, a, b: (i, f"sym:{path}#{name}", "Symbol", name, path, a, b, "python", "CONFIRMED", 0.9, "{}")
    nodes = [(i, f"file:{p}", "File", p, p, 0, 0, "python", "CONFIRMED", 1.0, "{}") for i, p in enumerate(["app/parcel.py", "tests/test_parcel.py"])]
    nodes += [sym(2, "app/parcel.py", "needs_approval", 2, 5), sym(3, "tests/test_parcel.py", "test_manager_orders_require_approval_first", 1, 2)]
    spark.createDataFrame(nodes, NODE).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([("r", "app/parcel.py", "python", 1, ORDER), ("r", "tests/test_parcel.py", "python", 1, TEST)], "repo string, path string, lang string, mtime long, content string").write.parquet(f"{folder}/discovered.parquet")
    spark.createDataFrame([(1, "r", "docs/handover.md", "a", "A", 1, 1, "Manager orders must get an approval before they ship.")], "section_id long, repo string, path string, slug string, title string, level int, line_no int, body string").write.parquet(f"{folder}/sections.parquet")
    spark.createDataFrame([("app/parcel.py:1", "def needs_approval(self)", "Approval of returned goods is required before they ship.")], "location string, signature string, documentation string").write.parquet(f"{folder}/why_answers.parquet")
    spark.createDataFrame([(f"{i}", "r", i, "fix order", ["app/parcel.py", "tests/test_parcel.py"], None) for i in range(3)], "sha string, repo string, authored_ts long, subject string, files array<string>, ingested_at timestamp").write.parquet(f"{folder}/commits.parquet")


def test_rules_come_from_the_tables(spark, tmp_path):
    write_tables(spark, tmp_path)
    d = f"file://{tmp_path}"
    assert {r.source for r in core.queries()["mined_rules"](spark, d).collect()} == {"document", "code_guard", "code_doc", "test"}
    found = core.queries()["rule_conflicts"](spark, d).collect()
    assert [r.documented_claim for r in found] == ["Manager orders must get an approval before they ship"] and "skip approval" in found[0].observed_claim
    assert {r.corroborated for r in core.queries()["corroborate"](spark, d).collect() if r.claim.startswith("Manager")} == {2}


def test_rules_of_an_invented_shop(spark):
    said = [
        ("document", "require", "Orders of strategic customers must get an approval", 0.7), ("code_guard", "bypass", "strategic customers orders skip approval", 0.8), ("test", "require", "strategic orders require approval", 0.9),
        ("document", "bypass", "Returned goods are exempt from approval", 0.7), ("code_doc", "require", "Approval of returned goods is required", 0.72),
    ]
    rows = spark.createDataFrame([(f"rule:{i}", "approval", *r, str(i), str(i)) for i, r in enumerate(said)], "rule string, subject string, source string, polarity string, claim string, confidence double, anchor string, location string")
    sure = rules.corroborate(rows)
    assert {(r.source, r.polarity): (r.corroborated, r.status) for r in sure.collect()} == {("document", "require"): (2, "OBSERVED"), ("test", "require"): (2, "OBSERVED"), ("code_doc", "require"): (2, "OBSERVED"), ("code_guard", "bypass"): (1, "INFERRED"), ("document", "bypass"): (1, "INFERRED")}
    assert {(r.documented, r.observed, r.shared) for r in rules.conflicts(sure).collect()} == {("rule:0", "rule:1", 3), ("rule:3", "rule:4", 2)}


def test_dump_has_edges_and_is_whole(spark, tmp_path):
    write_tables(spark, tmp_path)
    lines = [r.line for r in core.queries()["canonical_dump"](spark, f"file://{tmp_path}").collect()]
    assert lines == sorted(lines) and sum(x.startswith("N\t") for x in lines) == 4
    assert "E\tfile:app/parcel.py\tfile:tests/test_parcel.py\tCO_CHANGES_WITH\tOBSERVED\t0.5500" in lines
    assert [r["id"] for r in _rows(spark.range(2500).selectExpr("cast(id as int) as id").orderBy("id"))] == list(range(2500))
