"""Indexing an invented repository: planted facts, and refreshed equals built anew."""

import subprocess

from quarrylens.__main__ import main
from quarrylens.plans import answers
from quarrylens.plans.index import Index

ORDER = '''class ParcelDesk:
    """An order must have an approval of the manager before it ships."""

    def needs_approval(self):
        if self.manager_orders and self.depot == 12:
            return skip_approval
        return True

    def keep(self):
        db.sql("INSERT INTO parcel_audit VALUES (1)")
'''
FILES = {
    "app/parcel.py": ORDER, "app/ledger.py": 'class Ledger:\n    def list_all(self):\n        return db.sql("select * from parcel_audit")\n', "app/rounds.py": "from app.parcel import ParcelDesk\n\ndef collect_all():\n    return needs_approval()\n",
    "tests/test_parcel.py": "def test_manager_orders_require_approval_first():\n    needs_approval()\n", "db/schema.sql": "CREATE TABLE customer (id INT);\n", "docs/handover.md": "# Parcel audit\nManager orders must get an approval before they ship.\n## Exemptions\nNone.\n",
    "i18n/vi.csv": "Parcel Desk,Quầy bưu kiện\nNowhere Named,Không có\n", "conf/texts.properties": "a.title=Collect all\n", "conf/texts_de.properties": "a.title=Alles einsammeln\n", "pkg/__init__.py": "def opened_first():\n    pass\n",
    "app/depot.json": '{"name": "Depot Shelf", "fields": [{"fieldname": "shelf_no", "label": "Shelf", "fieldtype": "Data"}, {"fieldname": "line", "fieldtype": "Section Break"}]}',
    "map/Crate.hbm.xml": '<mapping><class name="a.b.Crate" table="CRATE_ROW"><id name="id"/></class></mapping>', "docs/hand.rtf": "{\\rtf1 Crates must be weighed before they leave the depot gate.}", "docs/draft-1.md": "# Draft\nx\n",
    "glossary.toml": '[concept.APPROVAL]\nlabels = { eng = "approval", vie = "phê duyệt" }\ncode = ["needs_approval"]\ntables = []\n',
}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e", *args], check=True, capture_output=True)


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


def dump(index):
    return [r.line for r in index.dump().collect()]


def test_planted_facts_and_refresh(spark, tmp_path, capsys):
    root = tmp_path / "repo"
    write(root, FILES | {"docs/.gitignore": "draft*\n"})
    git(root.parent, "init", "-q", str(root))
    git(root, "add", ".")
    git(root, "commit", "-qm", "feat: orders")
    index = Index(spark, f"file://{tmp_path}/one")
    first = index.update(str(root))
    assert first["changed"] and first["changes"] == {"new": len(FILES) - 1}
    found = {r.uid: r for r in index.nodes().collect()}
    assert {"db:tabdepot shelf", "db:crate_row", "concept:DEPOT_SHELF", "concept:PARCEL_DESK", "concept:COLLECT_ALL", "sym:pkg/__init__.py#opened_first", "doc:docs/hand.rtf#section"} <= set(found)
    assert "doc:docs/draft-1.md#draft" not in found and "concept:NOWHERE_NAMED" not in found and {r.what for r in index.facts("symbol").collect()} == {"class", "function"}
    assert index.rules(0).count() and index.conflicts().count() == 1 and sum(r.concepts for r in index.concepts().collect()) == sum(u.startswith("concept:") for u in found)
    assert [r.source for r in index.evidence(index.rules(0).where("source = 'document'").first().rule).collect()] == ["document"]
    assert index.bodies().where("text like '%weighed%'").count() == 1
    assert index.update(str(root))["changed"] is False and index.status(str(root))["fresh"]
    edges = {(r.src, r.dst, r.kind) for r in index.edges().collect()}
    requires = "sym:app/parcel.py#ParcelDesk.needs_approval"
    assert ("sym:app/rounds.py#collect_all", requires, "CALLS") in edges
    assert ("file:app/rounds.py", "file:app/parcel.py", "IMPORTS") in edges
    assert ("sym:app/parcel.py#ParcelDesk.keep", "db:parcel_audit", "WRITES") in edges and ("sym:app/ledger.py#Ledger.list_all", "db:parcel_audit", "READS") in edges
    assert (requires, "sym:tests/test_parcel.py#test_manager_orders_require_approval_first", "TESTED_BY") in edges
    assert ("concept:APPROVAL", requires, "MAPS_TO") in edges
    assert ("file:app/parcel.py", requires, "CALLS") not in edges
    assert any(k == "CONTRADICTS" for _, _, k in edges) and any(k == "INTRODUCED_BY" for _, _, k in edges)
    assert ("sym:app/ledger.py#Ledger.list_all", "data") in {(r.uid, r.how) for r in answers.impact(index.nodes(), index.edges(), "keep").collect()}

    write(root, {"app/parcel.py": ORDER.replace("def keep", "def keep_all"), "app/extra.py": "def needs_approval():\n    pass\n"})
    (root / "app/ledger.py").unlink()
    (root / "docs/handover.md").unlink()
    second = index.update(str(root))
    assert second["changes"] == {"changed": 1, "new": 1, "gone": 2} and not index.reused_concepts
    fresh = Index(spark, f"file://{tmp_path}/two")
    fresh.update(str(root))
    assert dump(index) == dump(fresh)
    write(root, {"app/rounds.py": FILES["app/rounds.py"] + "\n# more\n"})
    assert index.update(str(root))["changes"] == {"changed": 1} and index.reused_concepts and index.reused_rules
    calls = {(r.src, r.dst): r.confidence for r in index.edges().where("kind = 'CALLS'").collect()}
    assert calls[("sym:app/rounds.py#collect_all", requires)] == 0.5
    out = main(["context", str(root), f"file://{tmp_path}/one", "fix needs_approval of the order", "--json"])
    assert out["taken"] and "needs_approval" in capsys.readouterr().out
