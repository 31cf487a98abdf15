"""Concepts, rules, history, search, ranking and answers on a small invented shop."""

import math

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import lexicon as lex
from quarrylens.operators import concepts, evaluate, history, ranking, rules, search
from quarrylens.plans import answers

NODE = "uid string, kind string, name string, path string, line_start int, line_end int, lang string, status string, confidence double, payload string, tokens long"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("file:shop/order.py", "File", "order.py", "shop/order.py", 0, 60, "python"), ("sym:shop/order.py#Order", "Symbol", "Order", "shop/order.py", 1, 50, "python"),
        ("sym:shop/order.py#Order.requires_approval", "Symbol", "requires_approval", "shop/order.py", 5, 15, "python"), ("sym:shop/order.py#Order.recordApproval", "Symbol", "recordApproval", "shop/order.py", 16, 30, "python"),
        ("file:shop/report.py", "File", "report.py", "shop/report.py", 0, 20, "python"), ("sym:shop/report.py#run", "Symbol", "run", "shop/report.py", 1, 20, "python"), ("sym:shop/batch.py#nightly", "Symbol", "nightly", "shop/batch.py", 1, 9, "python"),
        ("db:approval_log", "DatabaseObject", "approval_log", None, None, None, None), ("concept:APPROVAL", "Concept", "APPROVAL", None, None, None, None), ("rule:1", "BusinessRule", "orders must be approved", None, None, None, None),
    ]
    return spark.createDataFrame([(*r, "CONFIRMED", 1.0, "{}", 20) for r in rows], NODE)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        ("sym:shop/batch.py#nightly", "sym:shop/order.py#Order.requires_approval", "CALLS", 0.9), ("sym:shop/order.py#Order", "sym:shop/order.py#Order.recordApproval", "CALLS", 0.5), ("sym:shop/order.py#Order.recordApproval", "db:approval_log", "WRITES", 0.8),
        ("sym:shop/report.py#run", "db:approval_log", "READS", 0.8), ("concept:APPROVAL", "sym:shop/order.py#Order.requires_approval", "MAPS_TO", 0.95), ("sym:shop/order.py#Order.requires_approval", "rule:1", "IMPLEMENTS_RULE", 0.8),
    ]
    return spark.createDataFrame([(a, b, k, "CONFIRMED", c) for a, b, k, c in rows], "src string, dst string, kind string, status string, confidence double")


def test_grounding_divides_by_all_words(spark, nodes):
    index = concepts.grounding_index(nodes)
    labels = spark.createDataFrame([("requires approval", ["requires", "approval"]), ("approval log", ["approval", "log"]), ("approval unicorn", ["approval", "unicorn"])], "label string, words array<string>")
    assert {(r.label, r.uid) for r in concepts.ground(labels, index).collect()} == {("requires approval", "sym:shop/order.py#Order.requires_approval"), ("approval log", "db:approval_log")}
    assert concepts.ground(labels.where("label = 'approval unicorn'"), index, relaxed=True).count() == 3


def test_concepts_merge_and_link(spark, nodes):
    rows = [
        (1, "APPROVAL", "eng", "approval", ["requires_approval"], None, "code-vocabulary", "INFERRED", 0.5), (2, "APPROVAL", "vie", "phê duyệt", None, ["approval_log"], "declared", "CONFIRMED", 0.95), (3, "APPROVAL", "eng", "second", None, None, "translation", "INFERRED", 0.8),
    ]
    merged = concepts.merge_concepts(spark.createDataFrame(rows, "ord int, concept string, lang string, label string, code array<string>, tables array<string>, bridge string, status string, confidence double"))
    r = merged.first()
    assert (r.labels, r.code, r.tables, r.bridge, r.status, r.confidence) == ({"eng": "approval", "vie": "phê duyệt"}, ["requires_approval"], ["approval_log"], "declared", "CONFIRMED", 0.95)
    links = concepts.concept_targets(merged, concepts.grounding_index(nodes))
    assert {x.uid for x in links.collect()} == {"sym:shop/order.py#Order.requires_approval", "sym:shop/order.py#Order.recordApproval", "db:approval_log"}
    assert [tuple(x) for x in concepts.overview(merged, links).collect()] == [("declared", 1, 1)]
    assert concepts.resolve_concepts(merged, ["approvals"]).first().concept == "APPROVAL"


def test_headings_translations_and_bundles(spark, nodes):
    index = concepts.grounding_index(nodes)
    sections = spark.createDataFrame([("Approval log",), ("Something else",), (None,)], "title string")
    assert [(r.concept, r.grounded) for r in concepts.heading_concepts(sections, index).collect()] == [("APPROVAL_LOG", 1)]
    pairs = spark.createDataFrame([(1, "Approval Log", "Nhật ký cũ"), (2, "Approval log", "Nhật ký"), (3, "Unknown words", "x")], "ord int, source string, target string")
    got = concepts.translation_concepts(pairs, index, "vie").collect()
    assert [(r.concept, r.labels) for r in got] == [("APPROVAL_LOG", {"eng": "Approval log", "vie": "Nhật ký"})]
    bundles = spark.createDataFrame([("m", None, "k", "Order"), ("m", "de", "k", "Auftrag"), ("m", "fr", "k", "Order"), ("m", "de", "orphan", "x")], "base string, locale string, key string, value string")
    assert [(r.locale, r.source, r.target) for r in concepts.join_bundles(bundles).collect()] == [("de", "Order", "Auftrag")]


def test_phrases_leave_out_ubiquitous_words(spark):
    names = [(f"u{i}", f"approve_order_line{'x' * i}") for i in range(4)] + [(f"v{i}", f"order_{'abcdefghij'[i % 10]}bc_{i}") for i in range(30)]
    got = concepts.code_phrases(spark.createDataFrame(names, "uid string, name string"), floor=10).collect()
    assert ("approve order", 4) not in {tuple(r) for r in got} and all("order" not in r.phrase.split() for r in got)


def test_rules_conflicts_and_corroboration(spark):
    sections = spark.createDataFrame([("doc:a", "docs/BRD.md", 3, "Orders above the limit must get manager approval first. Nothing here."), ("doc:h", "docs/CHANGELOG.md", 1, "Orders must get manager approval first.")], "uid string, path string, line_no int, body string")
    symbols = spark.createDataFrame([
        ("s1", "needs_approval", "app/order.py", 10, None, "def needs_approval(self):\n    if self.manager_orders and group == 7:\n        return skip_approval\n"), ("s2", "test_manager_orders_require_approval_first", "tests/test_order.py", 1, None, ""), ("s3", "x", "app/x.py", 1, "Manager orders must have an approval before they ship.", ""),
    ], "uid string, name string, path string, line_start int, documentation string, body string")
    found = rules.distinct_rules(rules.mine_documents(sections).unionByName(rules.mine_code(symbols)))
    by = {(r.source, r.polarity) for r in found.collect()}
    assert by == {("document", "require"), ("code_guard", "bypass"), ("test", "require"), ("code_doc", "require")}
    sure = rules.corroborate(found)
    assert {r.source: r.corroborated for r in sure.collect()} == {"document": 2, "test": 2, "code_doc": 2, "code_guard": 0}
    assert {r.source: (r.confidence, r.status) for r in sure.collect()}["document"] == (round(0.7 * 1.3, 4), "OBSERVED")
    clash = rules.conflicts(sure).collect()
    assert len(clash) == 1 and clash[0].shared >= 2
    staged_nodes, staged_edges, evidence = rules.staged(sure, rules.conflicts(sure))
    assert staged_nodes.count() == 5 and {r.kind for r in staged_edges.collect()} == {"IMPLEMENTS_RULE", "CONTRADICTS"} and evidence.count() == 4
    assert [r.confidence for r in rules.strong_rules(sure).collect()] == sorted((r.confidence for r in sure.collect()), reverse=True)


COMMITS = "sha string, repo string, authored_ts long, subject string, files array<string>, ingested_at timestamp"


def test_no_pair_is_dropped_over_many_repositories(spark):
    rows = [(f"{r}-{g}-{i}", r, i, "x", [f"{g}/{k}.py" for k in range(20)], None) for r in ("one", "two") for g in range(54) for i in range(3)]
    c = spark.createDataFrame(rows, COMMITS)
    assert history.co_changes(c).count() == 2 * 54 * 190
    best = history.co_changes(c, most=5).collect()
    assert sorted(r.repo for r in best) == ["one"] * 5 + ["two"] * 5


def test_history(spark):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    rows = [(f"S{i}", "r", i, "fix order approval", ["a.py", "b.py"], t) for i in range(4)] + [("s0", "r", 0, "fix order approval", ["b.py", "a.py", "a.py"], t), ("d", "r", 9, "docs: c", ["a.py"], t), ("big", "r", 5, "sweep", [f"{i}.py" for i in range(30)], t), ("n", "r", 6, None, None, t), (None, "r", 7, "x", ["z"], t)]
    c = spark.createDataFrame(rows, COMMITS)
    assert [(r.path_a, r.path_b, r.support, r.confidence) for r in history.co_changes(c).collect()] == [("a.py", "b.py", 4, 0.6)]
    assert [r.path for r in history.co_changed_with(history.co_changes(c), "b.py").collect()] == ["a.py"]
    assert {(r.path, r.sha) for r in history.introduced_by(c).where("path in ('a.py', 'b.py')").collect()} == {("a.py", "s0"), ("b.py", "s0")}
    assert [r.sha for r in history.recent_commits(c, 2).where("path = 'a.py'").collect()] == ["s3"]
    prior = history.term_prior(c)
    assert {r.term for r in prior.collect()} == {"approval", "fix", "order"} and history.prior_for(prior, ["order"]).first().path in ("a.py", "b.py")


def test_search_variants(spark):
    docs = spark.createDataFrame([(1, "customer approvals for the order"), (2, "order order order"), (3, "Nhà kho giữ hàng"), (4, ""), (5, None)], "k int, t string")
    top = search.bm25(docs, "k", "t", ["order", "approvals"]).collect()
    n, avg = 3, (5 + 3 + 3) / 3  # documents with tokens; in the third only runs of ASCII letters count
    lengths = {r.k: r.dl for r in search.postings(docs, "k", "t").select("k", "dl").distinct().collect()}
    avg = sum(lengths.values()) / len(lengths)
    n = len(lengths)
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {1: part(1, lengths[1], 2) + part(1, lengths[1], 1), 2: part(3, lengths[2], 2)}
    assert {r.k: r.score for r in top} == {k: round(v, 4) for k, v in want.items()}
    assert [r.k for r in search.prefix_search(search.postings(docs, "k", "t"), "k", ["approval"]).collect()] == [1]
    assert [r.k for r in search.substring_search(docs, "k", "t", ["kho", "x"]).collect()] == [3]
    scan = search.content_scan(docs, "k", "t", ["order", "kho"]).collect()
    assert [(r.k, r.distinct_terms, r.uses) for r in scan] == [(2, 1, 3), (1, 1, 1), (3, 1, 1)] and scan[0].score == 1.0
    packed = search.pack(spark.createDataFrame([("a", 5, 2.0), ("b", 10, 1.0), ("c", 1, 0.5)], "k string, n long, s double"), "k", "n", [F.desc("s")], 12)
    assert [(r.k, r.taken) for r in packed.collect()] == [("a", 5), ("b", 7)]
    folded = spark.createDataFrame([("Phê Duyệt Größe",)], "t string").select(search.fold(F.col("t")).alias("f")).first().f
    assert folded == "phe duyet große"


def test_scores_merge_by_maximum_or_sum(spark):
    s = spark.createDataFrame([("a", 1.0, "x"), ("a", 0.5, "y"), ("b", 0.01, "z")], "uid string, score double, reason string")
    assert {(r.uid, r.score, r.reason) for r in ranking.bump(s).collect()} == {("a", 1.0, "x"), ("b", 0.01, "z")}
    assert {(r.uid, r.score) for r in ranking.boost(s).collect()} == {("a", 1.5), ("b", 0.01)}
    assert [r.uid for r in ranking.ranked(ranking.bump(s)).collect()] == ["a"]
    f = spark.createDataFrame([("p", f"u{i}", 1.0 / (i + 1)) for i in range(5)] + [("q", "z", 0.1), (None, "n", 9.0)], "path string, uid string, score double")
    assert {(r.path, r.score) for r in ranking.file_scores(f).collect()} == {("p", round(1 + 0.5 + 1 / 3, 4)), ("q", 0.1)}
    assert [r.path for r in ranking.offered(ranking.file_scores(f)).collect()] == ["p"]


def test_answers(spark, nodes, edges):
    told = spark.createDataFrame([("shop/order.py:5", "says so")], "location string, documentation string")
    why = answers.why(nodes, edges, told, "requires_approval")
    assert [r.uid for r in why["callers"].collect()] == ["sym:shop/batch.py#nightly"] and why["concepts"].first().uid == "concept:APPROVAL" and why["rules"].count() == 1 and why["documents"].count() == 1
    assert [r.uid for r in answers.why(nodes, edges, told, "shop/order.py:20")["writes"].collect()] == ["db:approval_log"]
    assert {(r.uid, r.how) for r in answers.impact(nodes, edges, "recordApproval").collect()} == {("sym:shop/order.py#Order", "calls"), ("sym:shop/report.py#run", "data")}
    assert [r.uid for r in answers.explain(nodes, edges, "APPROVAL")["targets"].collect()] == ["sym:shop/order.py#Order.requires_approval"]
    assert [r.uid for r in answers.flow(nodes, edges, "requires_approval").collect()] == ["sym:shop/batch.py#nightly", "sym:shop/order.py#Order.requires_approval"]
    pre = answers.preflight(nodes, edges, "shop/order.py").first()
    assert (pre.concepts, pre.tables, pre.dependants, pre.rules, pre.conflicts, pre.risk) == (1, 1, 1, 1, 0, "MEDIUM")
    rep = answers.report(nodes, edges).first()
    assert (rep.files, rep.symbols, rep.tables, rep.edges, rep.documented_share) == (2, 5, 1, 6, 0.2)


def test_concepts_bring_in_their_other_words(spark, nodes):
    index = search.postings(nodes.withColumn("body", F.concat_ws(" ", F.translate("name", "_", " "), "path")), "uid", "body")
    named = nodes.unionByName(nodes.where("kind = 'Concept'").withColumn("uid", F.lit("concept:LOG")).withColumn("name", F.lit("approval nightly")))
    seeds = spark.createDataFrame([("concept:LOG", 0.8, "x"), ("sym:shop/report.py#run", 1.0, "y")], "uid string, score double, reason string")
    got = {r.uid: r.score for r in answers.concept_expansion(named, index, seeds, ["approval"]).collect()}
    assert got["sym:shop/batch.py#nightly"] > 0 and max(got.values()) == 0.4


def test_context_stays_within_its_budget(spark, nodes, edges):
    files = spark.createDataFrame([("shop/order.py", "def requires_approval(): pass"), ("shop/report.py", "x")], "path string, content string")
    prior = spark.createDataFrame([("approval", "shop/order.py", 2, 1.0)], "term string, path string, n long, score double")
    for budget in (60, 400):
        got = answers.context(nodes, edges, files, prior, "fix requires_approval for the order", budget)
        assert sum(r["tokens"] for r in got["taken"]) <= budget * 0.4
        assert sum(r["tokens"] for r in got["taken"]) + sum(r["tokens"] for r in got["reading"]) <= budget
    assert got["taken"][0]["uid"] and got["files"].first().path == "shop/order.py"
    again = answers.context(nodes, edges, files, prior, "fix requires_approval for the order", budget)
    assert again["taken"] == got["taken"]
    left = answers.context(nodes, edges, files, prior, "fix requires_approval", 400, exclude=["shop/order.py"])
    assert all(r["path"] != "shop/order.py" for r in left["taken"])
    rounds = answers.iterate(lambda ex: {"paths": [f"p{len(ex)}"], "tokens": 10})
    assert [r["cost"] for r in rounds] == [10, 20, 30] and rounds[2]["paths"] == ["p2"]


def test_evaluation_arithmetic(spark):
    truth = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "c")], "task string, path string")
    offers = spark.createDataFrame([("t1", "x", "z", 1, 10), ("t1", "x", "a", 2, 5), ("t2", "x", "q", 1, 7), ("t1", "y", "b", 1, 3)], "task string, condition string, path string, place int, tokens long")
    out = evaluate.score_outcomes(offers, truth)
    got = {(r.task, r.condition): (r.recall, r.precision, r.first_hit_rank, r.tokens_to_first_hit, r.wrong_files) for r in out.collect()}
    assert got == {("t1", "x"): (0.5, 0.5, 2, 15, 1), ("t2", "x"): (0.0, 0.0, None, None, 1), ("t1", "y"): (0.5, 1.0, 1, 3, 0)}
    s = {r.condition: r for r in evaluate.summarise(out).collect()}
    assert (s["x"].mrr, s["x"].hit_rate, s["x"].median_tokens_total) == (0.25, 0.5, 15)
    p = evaluate.paired(out, "x", "y").first()
    assert (p.tasks, p.both_hit, p.mean_saving) == (1, 1, 12.0)
    assert [(r.task, r.loss) for r in evaluate.losses(out, "y", "x").collect()] == [("t1", "dearer")]
    assert {r.condition: r.expected_tokens for r in evaluate.expected_tokens(out, 100).collect()} == {"x": 57.5, "y": 3.0}
    low, high = evaluate.wilson(F.lit(9), F.lit(40))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r.l, r.h) == (0.1232, 0.375)
    agents = spark.createDataFrame([("a", True, 1.0, None), ("a", False, 0.0, None), ("a", True, 1.0, "timeout")], "condition string, hit boolean, recall double, error string")
    a = evaluate.agent_summary(agents).first()
    assert (a.tasks, a.hits, a.hit_rate, a.errors, a.mean_recall) == (2, 1, 0.5, 1, 0.5)
    summary = spark.createDataFrame([("arm", 0.5), ("none", 0.2), ("oracle", 0.8)], "condition string, hit_rate double")
    assert evaluate.headroom(summary, "arm", "none", "oracle").first().headroom == 0.5
    ranks = spark.createDataFrame([("a", 1, True, True), ("b", 3, True, True), ("c", 9, True, True), ("d", 4, False, True), ("e", None, False, True), ("f", None, False, False)], "task string, place int, offered boolean, connected boolean")
    assert {r.verdict for r in evaluate.rank_audit(ranks).collect()} == {"first", "top3", "late", "cut", "unscored_connected", "unscored_unconnected"}
    best, value = evaluate.fit_weights({"a": 0.0, "b": 1.0}, {"a": [0.0, 1.0, 2.0], "b": [0.0, 1.0]}, lambda w: -abs(w["a"] - 1) - w["b"])
    assert best == {"a": 1.0, "b": 0.0} and value == 0
    table = evaluate.arm_table(spark.createDataFrame([("r", "x", 1, 1.0), ("q", "x", None, 0.0)], "repo string, condition string, first_hit_rank int, recall double")).collect()
    assert {(r.repo, r.tasks, r.hit_rate) for r in table} == {("r", 1, 1.0), ("q", 1, 0.0), ("ALL", 2, 0.5)}
    grades = spark.createDataFrame([("A", 1, True), ("B", 1, False), ("A", 2, True)], "arm string, instance int, resolved boolean")
    assert [tuple(r) for r in evaluate.common_grades(grades, "A", "B").collect()] == [("only_first", 1)]
    reading = spark.createDataFrame([("t", "b.py", 1, 10), ("t", "a.py", 0, 5), ("t", "b.py", 2, 7)], "task string, path string, ord int, tokens long")
    files = spark.createDataFrame([("t", "c.py", 1), ("t", "a.py", 2), ("t", "d.md", 3)], "task string, path string, rank int")
    assert [(r.path, r.place, r.tokens) for r in evaluate.offered_order(reading, files).orderBy("place").collect()] == [("a.py", 1, 5), ("b.py", 2, 17), ("c.py", 3, 0)]
    assert set(lex.SPREAD_KINDS) <= set(lex.EDGE_WEIGHTS)


def test_contenders_change_no_selection(spark):
    import random

    from quarrylens.operators import budget

    rng = random.Random(2)
    kinds = ["Symbol", "Symbol", "Concept", "DocSection", "File", "Commit"]
    rows = [(q, f"u{i}", rng.choice(kinds), rng.randrange(1, 6) / 4, rng.randrange(0, 9), rng.random() < 0.02) for q in ("a", "b") for i in range(300)]
    frame = spark.createDataFrame(rows, "query string, uid string, kind string, score double, tokens int, conflicted boolean")
    kept = budget.contenders(frame, 40).collect()
    assert len(kept) < len(rows)
    for q in ("a", "b"):
        whole = [dict(zip(frame.columns, r)) for r in rows if r[0] == q]
        assert [r["uid"] for r in budget.select([r.asDict() for r in kept if r.query == q], 40)] == [r["uid"] for r in budget.select(whole, 40)]


def test_words_of_any_script_are_found(spark):
    texts = [(1, "Phê DUYỆT đơn hàng"), (2, "Die Verkäufer zahlen"), (3, "주문은 닫힌다"), (4, "ลูกค้า จ่าย"), (5, "approvals of orders"), (6, ""), (7, None)]
    index = search.word_postings(spark.createDataFrame(texts, "k int, t string"), "k", "t")
    found = lambda *q: [r.k for r in search.prefix_search(index, "k", list(q)).collect()]
    assert found("duyet") == found("DUYỆT") == [1] and found("verkäufer") == [2] and found("주문은") == [3] and found("ลูกค้า") == [4] and found("approval") == [5]
    assert found("") == [] and search.prefix_search(index.where("false"), "k", ["order"]).count() == 0


def test_merged_regions_agree_with_brute_force(spark):
    import random

    from quarrylens.operators import budget

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.randrange(0, 40)) for s in (rng.randrange(0, 3000) for _ in range(150))] + [("c", 5, 9)]
    want = []
    for key in ("a", "b", "c", None):
        open_ = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if open_ and s - open_[1] <= 12:
                open_[1], open_[2] = max(open_[1], e), open_[2] + 1
            else:
                open_ = [s, e, 1]
                want.append((key, open_))
    got = budget.merge_regions(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e").collect()
    assert sorted(((r.k or "", r.s, r.e, r.spans) for r in got)) == sorted((k or "", *o) for k, o in want)
    assert budget.merge_regions(spark.createDataFrame([], "k string, s long, e long"), ["k"], "s", "e").count() == 0
