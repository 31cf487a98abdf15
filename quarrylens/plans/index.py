"""Building and refreshing the graph of a repository.

Files are listed by time and size, and only those that changed are read and extracted, once; the
facts of a file (its symbols, sections, accesses, imports, rules, messages) lie in one incremental
target. Every later stage is a pure function of facts; the dear ones are kept as long as the
fingerprint of their input stays the same. All stages of an update are published together, and a
refreshed index equals one built anew.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import concepts, extract, graph, history, resolve, rules
from quarrylens.operators.incremental import IncrementalTarget
from quarrylens.runtime import cut, ship
from quarrylens.sources import files as repo_files
from quarrylens.sources import records
from quarrylens.sources.documents import html_to_markdown
from quarrylens.sources.store import StageStore, frame_fingerprint, index_lock

#: Pairs changed together that the graph of one repository holds at most.
CO_CHANGE_MOST = 20_000
LOCK = ".quarrylens.lock"
NODE = ["uid", "kind", "name", "path", "line_start", "line_end", "lang", "status", "confidence", "payload"]
#: Columns of each kind of fact of a file.
FACTS = {
    "file": "path string, hash string, lang string, bytes long, lines int, text string",
    "symbol": "path string, lang string, name string, what string, line_start int, line_end int, bases array<string>, calls array<string>, doc string",
    "section": "path string, slug string, title string, level int, line_no int, body string",
    "access": "path string, line int, table string, access string",
    "import": "path string, module string",
    "rule": "path string, rule string, subject string, polarity string, source string, claim string, anchor string, location string, confidence double",
    "entity": "path string, name string, table string, label string, field string",
    "message": "path string, ord int, key string, value string, target string",
}
STAMPS = "path string, bytes long, mtime long, hash string"
DOCUMENTS = ["markdown", "text", "html", *repo_files.PACKED]


def _node(rows: DataFrame, kind: str, **columns) -> DataFrame:
    base = {"kind": F.lit(kind), "path": F.lit(None).cast("string"), "line_start": F.lit(0), "line_end": F.lit(0), "lang": F.lit(None).cast("string"), "status": F.lit("CONFIRMED"), "confidence": F.lit(1.0), "payload": F.lit("{}")}
    return rows.select(*[(base | columns)[c].alias(c) for c in NODE])


def _edge(rows: DataFrame, src, dst, kind: str | None, confidence, status: str = "CONFIRMED") -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), (F.lit(kind) if kind else F.col("kind")).alias("kind"), F.lit(status).alias("status"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"))


def _entities(files: DataFrame) -> DataFrame:
    """One row for each field of the entities that JSON definitions and XML mappings declare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "name", "table", "label", "field"]
        for batch in batches:
            out = []
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text"))):
                made = ([extract.entity(text)] if lang == "json" else extract.mapping(text)) if text else []
                for e in filter(None, made):
                    out += [(path, e["name"], e["table"], label, field) for field, label in e["fields"]] or [(path, e["name"], e["table"], None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(len(names))], names)

    return files.where("lang in ('json', 'xml') and text is not null").select("path", "lang", "text").mapInArrow(run, FACTS["entity"])


def _translated(files: DataFrame) -> DataFrame:
    """Rows of translation tables: source as key, and its translation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, k, source, source, target) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for k, (source, target) in enumerate(records.translations(text))]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], ["path", "ord", "key", "value", "target"])

    return files.where("lang = 'csv' and text is not null").select("path", "text").mapInArrow(run, FACTS["message"])


def facts_of(files: DataFrame) -> DataFrame:
    """All facts of files (path, hash, lang, bytes, lines, text), one row each, told apart by ``fact``."""
    content = files.select("path", "lang", F.col("text").alias("content"))
    symbols = cut(extract.symbols(content.where(F.col("lang").isin(T.lex.CODE_LANGUAGES)).withColumn("repo", F.lit(""))).drop("repo"))
    shown = F.when(F.col("lang") == "html", html_to_markdown(F.col("text"))).otherwise(F.col("text"))
    sections = extract.markdown_sections(files.where(F.col("lang").isin(*DOCUMENTS)).select("path", shown.alias("content")), "path", "content")
    own = F.array_join(F.slice(F.split("text", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    bodies = symbols.join(files.select("path", "text"), "path").select(
        extract.symbol_uid(F.col("path"), F.col("name")).alias("uid"), F.substring_index("name", ".", -1).alias("name"), "path", "line_start", F.col("doc").alias("documentation"), own.alias("body"))
    mined = lambda rows, at: rows.withColumn("path", at)
    symbol_path, section_path = F.regexp_extract("anchor", "^sym:(.*)#[^#]*$", 1), F.regexp_extract("anchor", "^doc:(.*)#[^#]*$", 1)
    told = mined(rules.mine_code(bodies), symbol_path).unionByName(mined(rules.mine_documents(sections.select(_doc_uid().alias("uid"), "path", "line_no", "body")), section_path))
    pairs = files.where("lang = 'properties'").select("path", F.posexplode(records.properties(F.col("text"))).alias("ord", "m")).select("path", "ord", "m.key", "m.value", F.lit(None).cast("string").alias("target"))
    parts = {
        "file": files.select("path", "hash", "lang", "bytes", F.col("lines").cast("int").alias("lines"), "text"), "symbol": symbols, "section": sections, "access": extract.table_access(content),
        "import": extract.import_lines(content), "rule": told, "entity": _entities(files), "message": pairs.unionByName(_translated(files)),
    }
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("fact", F.lit(kind)) for kind, rows in parts.items()]).drop("hash")


def _doc_uid():
    return F.concat(F.lit("doc:"), "path", F.lit("#"), "slug")


class Index:
    """The stored graph of one repository under ``store``, a folder all executors share."""

    def __init__(self, spark: SparkSession, store: str):
        ship(spark)
        self.spark, self.store = spark, store.rstrip("/")
        self.stages = StageStore(spark, f"{self.store}/stages")
        self.target = IncrementalTarget(spark, f"{self.store}/facts", ["path"], "hash")

    # -- stages -------------------------------------------------------------------------

    def facts(self, kind: str, live: DataFrame | None = None) -> DataFrame:
        """The facts of a kind, in order of path where read from the store."""
        rows = self.target.read() if live is None else live
        names = [c.strip().split(" ")[0] for c in FACTS[kind].split(",") if " " in c.strip()]
        names = [n for n in names if n != "hash"]
        if rows is None:
            return self.spark.createDataFrame([], FACTS[kind]).select(*names)
        return rows.where(F.col("fact") == kind).select(*names)

    def _nodes_and_edges(self, live: DataFrame, commits: DataFrame, glossary: list[dict]) -> tuple[DataFrame, DataFrame]:
        files, declared, sections, access, mined = (self.facts(k, live) for k in ("file", "symbol", "section", "access", "rule"))
        uid = extract.symbol_uid(F.col("path"), F.col("name"))
        file_uid = F.concat(F.lit("file:"), "path")
        file_nodes = _node(files, "File", uid=file_uid, name=F.substring_index("path", "/", -1), path=F.col("path"), line_end=F.col("lines").cast("int"), lang=F.col("lang"))
        bare = F.regexp_replace(F.substring_index("name", ".", -1), r"~\d+$", "")
        symbol_nodes = _node(declared, "Symbol", uid=uid, name=bare, path=F.col("path"), line_start=F.col("line_start"), line_end=F.col("line_end"), lang=F.col("lang"), payload=F.to_json(F.struct(F.left("doc", F.lit(400)).alias("summary"))))
        doc_nodes = _node(sections, "DocSection", uid=_doc_uid(), name=F.coalesce(F.nullif("title", F.lit("")), F.col("slug")), path=F.col("path"), line_start=F.col("line_no"), line_end=F.col("line_no"), payload=F.to_json(F.struct(T.excerpt("body").alias("summary"))))
        entities = self.facts("entity", live)
        tables = access.select("table").unionByName(entities.select("table")).where("table is not null").distinct()
        table_nodes = _node(tables, "DatabaseObject", uid=F.concat(F.lit("db:"), "table"), name=F.col("table"), status=F.lit("OBSERVED"), confidence=F.lit(0.9))
        commit_uid = F.concat(F.lit("commit:"), F.left("sha", F.lit(12)))
        commit_nodes = _node(commits, "Commit", uid=commit_uid, name=F.coalesce("subject", F.lit("")))

        grounded = cut(symbol_nodes.unionByName(table_nodes).select("uid", "kind", "name"))
        messages = self.facts("message", live)
        asked = sections.select(F.lit("s").alias("k"), F.col("title").alias("a"), F.lit(None).cast("string").alias("b"))
        asked = asked.unionByName(messages.select(F.concat_ws("|", "path", F.col("ord").cast("string"), "key").alias("k"), F.col("value").alias("a"), F.col("target").alias("b")))
        asked = asked.unionByName(entities.select(F.concat_ws("|", F.lit("e"), "name", "table").alias("k"), F.col("label").alias("a"), F.col("field").alias("b"))).unionByName(grounded.select(F.lit("g").alias("k"), F.col("uid").alias("a"), F.col("name").alias("b")))
        print_of = f"{frame_fingerprint(asked)}:{hash_of(glossary)}"
        words = concepts.grounding_index(grounded)
        found, self.reused_concepts = self.stages.cached("concepts", print_of, lambda: self._concepts(grounded, sections, messages, entities, cut(words), glossary))
        links, _ = self.stages.cached("links", print_of, lambda: concepts.concept_targets(found, cut(words)))
        concept_nodes = _node(found, "Concept", uid=F.concat(F.lit("concept:"), "concept"), name=T.concept_label(F.col("labels"), F.col("concept")), status=F.col("status"), confidence=F.col("confidence"))
        named = found.select("concept", F.explode("tables").alias("table"))

        rule_print = frame_fingerprint(mined)
        sure, self.reused_rules = self.stages.cached("rules", rule_print, lambda: rules.corroborate(rules.distinct_rules(mined.drop("path"))))
        clashes, _ = self.stages.cached("conflicts", rule_print, lambda: rules.conflicts(sure))
        rule_nodes, rule_edges, evidence = rules.staged(sure, clashes)
        self.stages.cached("evidence", rule_print, lambda: evidence)
        rule_nodes = _node(rule_nodes, "BusinessRule", uid=F.col("uid"), name=F.col("name"), status=F.lit("OBSERVED"), confidence=F.lit(0.7), payload=F.col("payload"))

        symbols = symbol_nodes.select("uid", "name", "path", "lang")
        calls = cut(resolve.resolve_references(extract.references(declared), symbols))
        tested = resolve.tested_by(calls, symbols, T.is_test_path)
        imports = resolve.module_edges(self.facts("import", live), files)
        owners = graph.innermost(symbol_nodes, access.select("path", "line").distinct())
        owned = access.join(owners, ["path", "line"], "left").withColumn("owner", F.coalesce("uid", file_uid))
        log = commits.select("sha", F.lit("").alias("repo"), "authored_ts", "subject", "files", F.lit(None).cast("timestamp").alias("ingested_at"))
        pairs, _ = self.stages.cached("pairs", self._head, lambda: history.co_changes(log, most=CO_CHANGE_MOST))
        parts = [
            _edge(graph.nesting(symbol_nodes), F.col("src"), F.col("dst"), "CALLS", 0.5),
            _edge(calls, F.col("from_uid"), F.col("uid"), None, F.col("confidence")),
            _edge(tested, F.col("src"), F.col("dst"), "TESTED_BY", F.col("confidence")),
            _edge(imports, file_uid, F.concat(F.lit("file:"), "target"), "IMPORTS", 0.9, "OBSERVED"),
            _edge(owned.withColumn("kind", F.when(F.col("access") == "write", "WRITES").otherwise("READS")), F.col("owner"), F.concat(F.lit("db:"), "table"), None, F.when(F.col("uid").isNull(), 0.9).otherwise(0.8), "OBSERVED"),
            _edge(links, F.concat(F.lit("concept:"), "concept"), F.col("uid"), "MAPS_TO", F.col("confidence"), "INFERRED"),
            _edge(named, F.concat(F.lit("concept:"), "concept"), F.concat(F.lit("db:"), "table"), "MAPS_TO", 0.9, "OBSERVED"),
            _edge(rule_edges, F.col("src"), F.col("dst"), None, F.col("confidence"), "OBSERVED"),
            _edge(pairs, F.concat(F.lit("file:"), "path_a"), F.concat(F.lit("file:"), "path_b"), "CO_CHANGES_WITH", F.col("confidence"), "OBSERVED"),
            _edge(history.introduced_by(log), file_uid, commit_uid, "INTRODUCED_BY", 1.0),
            _edge(history.recent_commits(log), file_uid, commit_uid, "CHANGED_BY", 1.0),
        ]
        all_nodes = reduce(DataFrame.unionByName, [file_nodes, symbol_nodes, doc_nodes, table_nodes, concept_nodes, rule_nodes, commit_nodes])
        return graph.upsert_nodes(all_nodes, "uid"), reduce(DataFrame.unionByName, parts)

    def _concepts(self, grounded: DataFrame, sections: DataFrame, messages: DataFrame, entities: DataFrame, words: DataFrame, glossary: list[dict]) -> DataFrame:
        """Concepts of the glossary, of entities, of translations, of headings and of the phrases of code, merged."""
        shape = "ord int, concept string, lang string, label string, code array<string>, tables array<string>, bridge string, status string, confidence double"
        declared = [(0, c["concept"], g, label, c["code"], c["tables"], "declared", "CONFIRMED", 0.95) for c in glossary for g, label in sorted(c["labels"].items())]
        none = F.lit(None).cast("array<string>")

        def staged(rows: DataFrame, ord_: int, concept, lang, label, bridge: str, confidence: float, status: str = "INFERRED", own=none) -> DataFrame:
            return rows.select(F.lit(ord_).alias("ord"), concept.alias("concept"), lang.alias("lang"), label.alias("label"), none.alias("code"), own.alias("tables"), F.lit(bridge).alias("bridge"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))

        english = F.lit("eng")
        made = entities.groupBy("name", "table").agg(F.count("field").alias("fields"))
        rows = self.spark.createDataFrame(declared, shape).unionByName(staged(made, 1, T.normalize_id("name"), english, F.col("name"), "declared", 0.9, "OBSERVED", F.array("table")))
        where = messages.withColumn("at", records.bundle_locale(F.col("path")))
        bundles = where.where("target is null").groupBy(F.col("at.base").alias("base"), F.col("at.lang").alias("locale"), "key").agg(F.max("value").alias("value"))
        joined = concepts.join_bundles(cut(bundles)).select(F.lit(0).alias("ord"), F.col("locale").alias("lang"), "source", "target")
        pairs = cut(where.where("target is not null and at.lang is not null").select("ord", F.col("at.lang").alias("lang"), F.col("value").alias("source"), "target").unionByName(joined))
        for lang in sorted(r.lang for r in pairs.select("lang").distinct().collect()):  # languages of the translations of one repository
            known = concepts.translation_concepts(pairs.where(F.col("lang") == lang), words, lang)
            for g in ("eng", lang):
                rows = rows.unionByName(staged(known, 2, F.col("concept"), F.lit(g), F.col("labels")[g], "translation", 0.8))
        heads = concepts.heading_concepts(sections, words)
        rows = rows.unionByName(staged(heads, 3, F.col("concept"), english, F.col("label"), "co-occurrence", 0.6))
        phrases = concepts.code_phrases(grounded.where("kind = 'Symbol'"))
        return concepts.merge_concepts(rows.unionByName(staged(phrases, 4, T.normalize_id("phrase"), english, F.col("phrase"), "code-vocabulary", 0.5)))

    # -- entry points -------------------------------------------------------------------

    def update(self, root: str, with_history: bool = True, progress: Callable[[str, float], None] | None = None) -> dict:
        """Bring the stored graph up to date with a working tree; says what was done and how long each part took.

        ``progress`` is told the name and the seconds of each part as it ends.
        """
        with index_lock(os.path.join(root, LOCK)):
            self.stages.hold()
            return self._update(root, with_history, progress or (lambda name, seconds: None))

    def _update(self, root: str, with_history: bool, progress: Callable[[str, float], None]) -> dict:
        clock, timings = time.time(), {}

        def tick(name: str) -> None:
            nonlocal clock
            timings[name], clock = round(time.time() - clock, 3), time.time()
            progress(name, timings[name])

        head = self._head = str(records.head_sha(root) if with_history else None)
        stamps = repo_files.stamps(self.spark, root).where(F.col("path") != LOCK)
        stamp = f"{frame_fingerprint(stamps)}@{head}"
        if self.stages.fingerprint("stamps") == stamp:
            tick("discover")
            return {"changed": False, "timings": timings}
        known = self.stages.read("stamps") if self.stages.fingerprint("stamps") else self.spark.createDataFrame([], STAMPS)
        listed = cut(repo_files.with_known_hash(stamps.withColumn("hash", F.lit(None).cast("string")), known))
        read = cut(repo_files.read_listed(listed.where("not unchanged"), root).where("skipped is null").drop("content", "skipped"))
        same = listed.where("unchanged").select("path", "bytes", "mtime", "hash")
        current = self.stages.write("stamps", same.unionByName(read.select("path", "bytes", "mtime", "hash")), stamp)
        changes = {r.change: r.n for r in repo_files.changed_files(current, known).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        tick("discover")
        if not changes and (self.stages.fingerprint("nodes") or "@").rsplit("@", 1)[-1] == head:
            self.stages.publish()  # touched without a change
            return {"changed": False, "timings": timings}
        source = same.select("path", "hash").join(read.limit(0).drop("bytes", "mtime", "hash"), "path", "left").unionByName(read.drop("mtime"), allowMissingColumns=True)
        self.target.sync(source, facts_of, complete=True)
        tick("extract")
        log, _ = self.stages.cached("commits", head, lambda: self._log(root, head))
        tick("history")
        glossary_path = os.path.join(root, "glossary.toml")
        glossary = records.glossary(open(glossary_path, encoding="utf-8").read()) if os.path.exists(glossary_path) else []
        live = self.target.read()
        live = (self.spark.createDataFrame([], "path string, fact string") if live is None else live).persist(StorageLevel.MEMORY_AND_DISK)
        mark = f"{stamp.rsplit('@', 1)[0]}@{head}"
        try:
            nodes, edges = self._nodes_and_edges(live, log, glossary)
            nodes = self.stages.write("nodes", nodes, mark)
            tick("nodes")
            self.stages.write("edges", graph.upsert_edges(edges, nodes, "confidence"), mark, ["kind"])
            tick("edges")
        finally:
            live.unpersist()
        self.stages.publish()
        tick("publish")
        return {"changed": True, "changes": changes, "timings": timings}

    def _log(self, root: str, head: str) -> DataFrame:
        """Commits with their bodies."""
        if head == "None":
            return self.spark.createDataFrame([], f"{records.COMMITS}, body string")
        told = list(records.bodies(root).items())
        return records.git_log(self.spark, root).join(self.spark.createDataFrame(told, "sha string, body string"), "sha", "left")

    def nodes(self) -> DataFrame:
        return self.stages.read("nodes")

    def edges(self) -> DataFrame:
        return self.stages.read("edges").select("src", "dst", "kind", "status", "confidence")

    def files(self) -> DataFrame:
        return self.facts("file").select("path", "lang", F.col("text").alias("content"))

    def bodies(self) -> DataFrame:
        """(uid, text) of what is searched beyond names: the text of sections."""
        return self.facts("section").select(_doc_uid().alias("uid"), F.concat_ws(" ", "title", "body").alias("text"))

    def rules(self, floor: float = 0.7) -> DataFrame:
        return rules.strong_rules(self.stages.read("rules"), floor)

    def conflicts(self) -> DataFrame:
        return self.stages.read("conflicts").orderBy("conflict")

    def evidence(self, uid: str) -> DataFrame:
        """(source, locator) of what backs a rule."""
        return self.stages.read("evidence").where(F.col("uid") == uid).select("source", "locator").distinct().orderBy("source", "locator")

    def concepts(self) -> DataFrame:
        """Concepts by where they come from, and how many have a target."""
        return concepts.overview(self.stages.read("concepts"), self.stages.read("links")).orderBy("bridge")

    def prior(self) -> DataFrame:
        log = self.stages.read("commits").select("sha", F.lit("").alias("repo"), "authored_ts", "subject", "files", F.lit(None).cast("timestamp").alias("ingested_at"), "body")
        return history.term_prior(log, self.facts("file").select(F.lit("").alias("repo"), "path"))

    def dump(self) -> DataFrame:
        return graph.canonical_dump(self.nodes(), self.edges())

    def status(self, root: str) -> dict:
        """Whether the stored graph is that of the present commit, and how many files it holds."""
        stored = (self.stages.fingerprint("nodes") or "@").rsplit("@", 1)[-1]
        return {"indexed": stored, "head": records.head_sha(root), "fresh": stored == str(records.head_sha(root)), "files": self.stages.read("stamps").count() if self.stages.fingerprint("stamps") else 0}


def hash_of(glossary: list[dict]) -> str:
    return hashlib.sha256(repr(glossary).encode()).hexdigest()[:16]
