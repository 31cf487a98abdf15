import io
import os
import subprocess
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarrylens.operators import budget, extract
from quarrylens.sources import documents, files, records, store
from quarrylens.streaming import listings


def test_walking_a_repository(spark, tmp_path):
    for name, body in {"app/a.py": b"x = 1\ny = 2\n", "node_modules/m.js": b"x", "app/b.min.js": b"x", "notes/skip.md": b"s", "notes/keep.md": b"k", "bin.dat": b"a\x00b", "doc.docx": b"PK\x00"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / ".gitignore").write_text("# c\nnotes/*\n!notes/keep.md\n")
    rows = {r.path: r for r in files.walk(spark, str(tmp_path)).collect()}
    assert {p: r.skipped for p, r in rows.items() if p != ".gitignore"} == {"app/a.py": None, "node_modules/m.js": "folder", "app/b.min.js": "generated", "notes/skip.md": "ignored", "notes/keep.md": None, "bin.dat": "binary", "doc.docx": None}
    assert rows["app/a.py"].lines == 2 and rows["app/a.py"].lang == "python"
    assert {(r.reason, r.files) for r in files.skip_summary(files.walk(spark, str(tmp_path))).collect()} == {("binary", 1), ("folder", 1), ("generated", 1), ("ignored", 1)}


def test_what_changed(spark):
    now = spark.createDataFrame([("a", "1", 5, 9), ("b", "2", 5, 9), ("c", "9", 5, 0)], "path string, hash string, bytes long, mtime long")
    old = spark.createDataFrame([("a", "1", 5, 9), ("b", "0", 5, 9), ("c", "3", 5, 0), ("d", "4", 1, 1)], "path string, hash string, bytes long, mtime long")
    assert {tuple(r) for r in files.changed_files(now, old).collect()} == {("b", "changed"), ("c", "changed"), ("d", "gone")}
    assert {r.path: (r.hash, r.unchanged) for r in files.with_known_hash(now, old).collect()} == {"a": ("1", True), "b": ("0", True), "c": ("9", False)}


def test_pages_become_text(spark):
    html = "<html><head><title>x</title></head><body><script>var s = '</p>';</script><h2 class=a>Approval &amp; log</h2><p>One<br>two</p><!-- no --></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(documents.html_to_markdown(F.col("h")).alias("t")).first().t
    assert got == "## Approval & log\nOne\ntwo"
    assert documents.rtf_to_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par w\'f6rld \u8364?}") == "Hello\nwörld €"


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_packed_documents():
    w = "xmlns:w='w'"
    docx = packed({"word/document.xml": f"<w:d {w}><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t><w:t>dy</w:t></w:r></w:p></w:d>"})
    assert documents.packed_to_markdown(docx, "docx") == "## Title\nBody"
    odt = packed({"content.xml": "<o xmlns:t='t'><t:h t:outline-level='1'>T</t:h><t:p>b</t:p></o>"})
    assert documents.packed_to_markdown(odt, "odt") == "# T\nb"
    xlsx = packed({"xl/sharedStrings.xml": "<s><si><t>Name</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>3</v></c></row></w>"})
    assert documents.packed_to_markdown(xlsx, "xlsx") == "# sheet1\n| Name | 3 |"
    pptx = packed({"ppt/slides/slide2.xml": "<s xmlns:a='a'><a:p><a:t>Second</a:t></a:p></s>", "ppt/slides/slide1.xml": "<s xmlns:a='a'><a:p><a:t>First</a:t></a:p><a:p><a:t>line</a:t></a:p></s>"})
    assert documents.packed_to_markdown(pptx, "pptx") == "# First\nline\n# Second"
    assert documents.packed_to_markdown(b"no zip", "docx") is None


def test_log_and_small_formats(spark, tmp_path):
    sha = "a" * 40
    log = f"{sha}\x0010\x00Ann\x00fix: x\n\x00a.py\x00b c.py\x00" + "b" * 40 + "\x0020\x00Bob\x00no files"
    assert [(r[1], r[3], r[4]) for r in records.parse_log(log)] == [(10, "fix: x", ["a.py", "b c.py"]), (20, "no files", [])]
    repo = tmp_path / "repo"
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / "x.py").write_text("1")
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("add", "."), run("commit", "-qm", "feat: first")
    row = records.git_log(spark, str(repo)).first()
    assert (row.subject, row.files, row.sha) == ("feat: first", ["x.py"], records.head_sha(str(repo)))
    run("commit", "--allow-empty", "-qm", "second\n\nThe body of it.")
    assert list(records.bodies(str(repo)).values()) == ["The body of it."]
    assert [x[1] for x in records.line_history(str(repo), "x.py", 1, 1, 10)] == ["feat: first"] and records.line_history(str(repo), "none.py", 1, 1) == []
    assert files.read_one(spark, str(repo), "x.py").first().text == "1"
    paths = spark.createDataFrame([("a/messages_de.properties",), ("i18n/vi.csv",), ("a/messages.properties",), ("a/order_zz.properties",), ("x/labels-pt-BR.json",)], "p string")
    got = {tuple(r.b) for r in paths.select(records.bundle_locale(F.col("p")).alias("b")).collect()}
    assert got == {("a/messages", "deu"), ("i18n", "vie"), ("a/messages", None), ("a/order_zz", None), ("x/labels", "por")}
    assert records.markdown_table(spark.createDataFrame([("a", 0.5, None)], "x string, y double, z int"), "T").splitlines()[-1] == "| a | 0.5 | – |"
    assert records.translations('Order,Auftrag\nSame,Same\nctx,"A, b",C\n,x\n') == [("Order", "Auftrag"), ("A, b", "C")]
    text = "# c\n! d\nkey = one \\\n   two\nb:x\nempty=\nnone\n"
    got = spark.createDataFrame([(text,)], "t string").select(records.properties(F.col("t")).alias("p")).first().p
    assert [tuple(x) for x in got] == [("key", "one two"), ("b", "x"), ("empty", "")]
    concepts = [{"concept": "APPROVAL", "labels": {"eng": "approval", "vie": "phê duyệt"}, "code": ["a_b"], "tables": []}]
    assert records.glossary(records.render_glossary(concepts)) == concepts
    assert records.toon(spark.createDataFrame([("a|b", None)], "x string, y string"), "rows") == "rows[1]{x,y}:\n  a/b|"


def test_declarations_of_languages(spark):
    python = "class A(B):\n    def f(self):\n        return g(1)\n\ndef f():\n    '''D.'''\ndef f():\n    pass\n"
    assert [(d[0], d[1], d[2]) for d in extract.declarations(python, "python")] == [("A", "class", 1), ("A.f", "function", 2), ("f", "function", 5), ("f~2", "function", 7)]
    assert [d[0] for d in extract.declarations("def f(:\n  x\nclass A:\n", "python")] == []
    js = "export const add = (a, b) => {\n  return sum(a, b);\n};\nclass X extends Y {\n}\n"
    assert [(d[0], d[1], d[2], d[3], d[4], d[5]) for d in extract.declarations(js, "javascript")] == [("add", "function", 1, 3, [], ["sum"]), ("X", "class", 4, 5, ["Y"], [])]
    frame = spark.createDataFrame([("r", "a.py", "python", python), ("r", "b.py", "python", None)], "repo string, path string, lang string, content string")
    declared = extract.symbols(frame)
    assert declared.count() == 4
    assert {(r.name, r.kind) for r in extract.references(declared).collect()} == {("g", "CALLS"), ("B", "INHERITS")}
    lines = spark.createDataFrame([("a.ts", "import x from './m';\nconst y = 1;\n"), ("b.rs", "use crate::z;\n")], "path string, content string")
    assert {(r.path, r.module) for r in extract.import_lines(lines).collect()} == {("a.ts", "./m"), ("a.ts", "x"), ("b.rs", "crate::z;")}


def test_sections_entities_and_table_access(spark):
    text = "intro\n# One\nbody\n```\n# no heading\n```\n## Two words\nx\n# One\n"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    rows = [(r.slug, r.title, r.level, r.line_no) for r in extract.markdown_sections(frame, "k", "t").collect()]
    assert rows == [("section", "", 0, 1), ("one", "One", 1, 2), ("one.two-words", "Two words", 2, 7), ("one~2", "One", 1, 9)]
    entity = extract.entity('{"name": "Sales Order", "fields": [{"fieldname": "a", "label": "A", "fieldtype": "Data"}, {"fieldname": "s", "fieldtype": "Section Break"}]}')
    assert entity == {"name": "Sales Order", "table": "tabsales order", "fields": [("a", "A")]} and extract.entity("[]") is None and extract.entity(None) is None
    assert extract.mapping("<m><class name='a.B' table='T'><id name='id' column='b_id'/><property name='p'/></class></m>") == [{"name": "B", "table": "t", "fields": [("id", "b_id"), ("p", "p")]}]
    code = spark.createDataFrame([("a.sql", "sql", "CREATE TABLE t1 (a int); SELECT * FROM t2;"), ("b.py", "python", "x = 1\nq = 'select a from orders'\n")], "path string, lang string, content string")
    assert {tuple(r) for r in extract.table_access(code).collect()} == {("a.sql", 1, "t1", "write"), ("a.sql", 1, "t2", "read"), ("b.py", 2, "orders", "read")}
    spans = spark.createDataFrame([("o", "p", 1, 4), ("i", "p", 2, 3)], "uid string, path string, line_start int, line_end int")
    assert sorted((r.uid, r.line) for r in extract.without_nested(spans).collect()) == [("i", 2), ("i", 3), ("o", 1), ("o", 4)]


def test_stages_are_reused_for_the_same_input(spark, tmp_path):
    s = store.StageStore(spark, f"file://{tmp_path}/stages")
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, "a")], "k int, v string")

    assert s.cached("x", "f1", make)[1] is False and s.cached("x", "f1", make)[1] is True and s.cached("x", "f2", make)[1] is False
    assert len(made) == 2 and s.read("x").count() == 1
    a = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert store.frame_fingerprint(a) == store.frame_fingerprint(a.orderBy(F.desc("k"))) != store.frame_fingerprint(a.union(a))
    lock = str(tmp_path / "lock")
    with store.index_lock(lock):
        with pytest.raises(RuntimeError):
            with store.index_lock(lock):
                pass
    with open(lock, "w", encoding="ascii") as f:
        f.write("999999999")
    with store.index_lock(lock):
        assert open(lock, encoding="ascii").read() == str(os.getpid())


def test_streamed_listings_are_applied_once(spark, tmp_path):
    from quarrylens.operators.incremental import IncrementalTarget

    source, schema = tmp_path / "in", "repo string, path string, hash string"
    target = IncrementalTarget(spark, f"file://{tmp_path}/t", ["repo", "path"], "hash")
    for rows in ([("r", "./a", "H"), ("r", "b", "x")], [("r", "a", "h"), ("r", "b", "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        listings.keep_current(spark.readStream.schema(schema).parquet(str(source)), target, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in target.read().select("repo", "path", "hash").collect()} == {("r", "a", "h"), ("r", "b", "y")}
    events = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:10:00"), (1, "2025-01-01 05:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in listings.sessions(events).collect()) == [1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["Symbol", "Concept", "DocSection", "File"]), st.floats(0, 2), st.integers(1, 60), st.booleans()), max_size=30), st.integers(0, 400))
def test_selection_keeps_its_budget(rows, size):
    items = [{"uid": f"u{i}", "kind": k, "score": s, "tokens": t, "conflicted": c and i % 5 == 0} for i, (k, s, t, c) in enumerate(rows)]
    taken = budget.select(items, size)
    assert sum(r["tokens"] for r in taken if not r["conflicted"]) <= size
    assert all(r in taken for r in items if r["conflicted"])
    assert len({r["uid"] for r in taken}) == len(taken) and budget.select(items, size) == taken


def test_plans_skip_what_does_not_fit(spark):
    regions = [{"path": "a", "start": 1, "end": 10}, {"path": "b", "start": 1, "end": 100}, {"path": "c", "start": 1, "end": 5}]
    assert [r["path"] for r in budget.reading_plan(regions, 160)] == ["a", "c"]
    assert [r["k"] for r in budget.take_within([{"k": 1, "tokens": 5}, {"k": 2, "tokens": 9}, {"k": 3, "tokens": 4}], 10)] == [1, 3]
    plan = budget.edit_plan([{"path": "x", "start": 500, "end": 510}, {"path": "x", "start": 520, "end": 530}, {"path": "y", "start": 3, "end": 4}], {"x": 900, "y": 30}, 10_000)
    assert [(r["path"], r["start"], r["end"]) for r in plan] == [("x", 1, 40), ("x", 488, 534), ("y", 1, 30)]
    frame = spark.createDataFrame([("Python", f"u{i}", "Symbol", 1.0, 100, False) for i in range(5)], "query string, uid string, kind string, score double, tokens long, conflicted boolean")
    assert budget.select_each(frame, 300).count() == 3


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 10)), min_size=1, max_size=12))
def test_merged_regions_agree_with_a_plain_sweep(spark, spans):
    rows = [("k", a, a + n) for a, n in spans]
    plain = []
    for _, a, b in sorted(rows):
        if plain and a - plain[-1][1] <= 3:
            plain[-1][1] = max(plain[-1][1], b)
        else:
            plain.append([a, b])
    got = budget.merge_regions(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], "a", "b", 3).orderBy("a").collect()
    assert [[r.a, r.b] for r in got] == plain
