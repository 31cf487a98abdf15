"""Registry of the core queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import budget, concepts, evaluate, extract, graph, history, incremental, ranking, resolve, rules, search
from quarrylens.plans import answers, function_queries, tables
from quarrylens.plans.oracles import ORACLES
from quarrylens.plans.rule_sql import RULE_ORACLES
from quarrylens.runtime import cut, pick, scratch_path, table
from quarrylens.sources import files as repo_files
from quarrylens.streaming import listings

Query = Callable[[SparkSession, str], DataFrame]

WORDS = ["approval", "discount", "warehouse"]
LABELS = ["approve payment", "order status", "close period", "invoice total", "release stock", "match bank", "customer group"]


def _bm25(s: SparkSession, d: str, most: int | None = 20) -> DataFrame:
    return search.bm25(table(s, d, "documents").where("text is not null"), "doc_id", "text", WORDS, most)


def bm25_coverage_rank(s: SparkSession, d: str) -> DataFrame:
    """Matching documents by their share of the best score times the share of asked words they hold."""
    rows = _bm25(s, d, None)
    best = rows.agg(F.max("score").alias("best"))
    value = F.col("score") / F.col("best") * (0.35 + 0.65 * F.col("matched") / len(WORDS))
    return rows.crossJoin(F.broadcast(best)).select("doc_id", "matched", F.round(value, 4).alias("rank_score"))


def file_aggregate_top3(s: SparkSession, d: str) -> DataFrame:
    rows = _bm25(s, d, None).join(pick(table(s, d, "documents"), "doc_id", "source"), "doc_id")
    return ranking.file_scores(rows.select("source", "doc_id", "score"), "source", "doc_id")


def offer_cutoff(s: SparkSession, d: str) -> DataFrame:
    return ranking.offered(file_aggregate_top3(s, d), 0.5)


def pack_context(s: SparkSession, d: str) -> DataFrame:
    sized = pick(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.char_length("text").cast("long").alias("size"))
    return search.pack(_bm25(s, d, None).join(sized, "doc_id"), "doc_id", "size", [F.desc("score"), F.col("doc_id")], 12_000)


def substring_fallback(s: SparkSession, d: str) -> DataFrame:
    return search.substring_search(table(s, d, "documents").where("text is not null"), "doc_id", "text", ["entrep", "schreib", "almac", "kho"])


def token_totals(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "documents"), "lang", "text").where("text is not null")
    return rows.groupBy("lang").agg(F.sum(T.token_estimate("text")).alias("tokens"))


def text_functions(s: SparkSession, d: str) -> DataFrame:
    """Words, ids and slugs of the names of nodes."""
    rows = pick(table(s, d, "nodes"), "name").distinct()
    return rows.select("name", F.array_join(T.split_identifier("name"), " ").alias("words"), T.normalize_id("name").alias("concept"), T.slugify("name").alias("slug"), F.array_join(F.transform(T.split_identifier("name"), T.stem), " ").alias("stems"))


def subject_words(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "commits"), "subject").where("subject is not null").distinct()
    return rows.select("subject", F.array_join(T.meaningful_words("subject"), " ").alias("words"), T.commit_class("subject").alias("change_class"))


def path_predicates(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "files"), "path").where("path is not null").select(incremental.normal_path(F.col("path")).alias("path")).distinct()
    return rows.groupBy(T.file_language("path").alias("lang")).agg(F.count(F.lit(1)).alias("paths"), F.count_if(T.is_test_path("path")).alias("tests"), F.count_if(T.is_specification("path")).alias("specifications"))


def file_skip_summary(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "discovered"), "path", "content").where("path is not null").distinct()
    content = F.encode(F.coalesce("content", F.lit("")), "utf-8")
    return repo_files.skip_summary(rows.withColumn("skipped", repo_files.skip_reason(F.col("path"), F.octet_length(content), content, [])))


def last_two_listings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Listings of the last succeeded run of each repository and of the one before, keyed by repository and path."""
    runs = incremental.succeeded_runs(table(s, d, "index_runs"))
    back = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))
    ranked = runs.withColumn("back", back).select("run_id", "repo", "back")
    listing = incremental.run_listing(table(s, d, "files")).join(ranked.where("back <= 2"), "run_id")
    keyed = listing.select(F.concat_ws(" ", "repo", "path").alias("path"), "hash", "back")
    return keyed.where("back = 1").drop("back"), keyed.where("back = 2").drop("back")


def changed_files(s: SparkSession, d: str) -> DataFrame:
    return repo_files.changed_files(*last_two_listings(s, d))


def stat_skip(s: SparkSession, d: str) -> DataFrame:
    """How many listed files of the last runs a stored record with the same time and size spares reading."""
    rows = pick(table(s, d, "files"), "repo", "run_id", "path", "hash", "bytes", "mtime", "listed_at").where("path is not null")
    one = rows.groupBy("repo", "run_id", incremental.normal_path(F.col("path")).alias("p")).agg(F.max(F.struct("listed_at", "hash", "bytes", "mtime")).alias("r"))
    keyed = one.select("repo", "run_id", F.concat_ws(" ", "repo", "p").alias("path"), F.lower("r.hash").alias("hash"), "r.bytes", "r.mtime")
    runs = incremental.succeeded_runs(table(s, d, "index_runs"))
    back = runs.withColumn("back", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))).select("run_id", "back")
    both = keyed.join(back.where("back <= 2"), "run_id")
    found = repo_files.with_known_hash(both.where("back = 1").select("repo", "path", "hash", "bytes", "mtime"), both.where("back = 2"))
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_if("unchanged").alias("spared"))


def node_upsert(s: SparkSession, d: str) -> DataFrame:
    return tables.nodes(s, d).select("uid", "kind", "name", "path", "status", F.round("confidence", 4).alias("confidence"))


def innermost_span(s: SparkSession, d: str) -> DataFrame:
    points = pick(table(s, d, "why_answers"), "location").where("location is not null").distinct()
    points = points.select(F.regexp_extract("location", r"^(.*):(\d+)$", 1).alias("path"), (F.regexp_extract("location", r"^(.*):(\d+)$", 2).cast("int") + 1).alias("line"))
    return graph.innermost(tables.nodes(s, d).where("kind = 'Symbol'"), points)


def nesting(s: SparkSession, d: str) -> DataFrame:
    return graph.nesting(tables.nodes(s, d))


def resolve_refs(s: SparkSession, d: str) -> DataFrame:
    symbols = tables.nodes(s, d).where("kind = 'Symbol'")
    return resolve.resolve_references(tables.call_references(s, d), symbols).select("from_uid", "uid", F.round("confidence", 4).alias("confidence"))


def unresolved(s: SparkSession, d: str) -> DataFrame:
    """Files of commits that no node stands for."""
    pairs = history.commit_files(table(s, d, "commits")).select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("commit:"), F.left("sha", F.lit(12))).alias("dst"))
    n = tables.nodes(s, d)
    return pairs.join(n.select(F.col("uid").alias("src")), "src", "left_anti").groupBy("src").agg(F.count_distinct("dst").alias("commits"))


def impact_reach(s: SparkSession, d: str) -> DataFrame:
    """Nodes within two calls of the symbols that release something."""
    e = cut(tables.edges(s, d)).where("kind = 'CALLS'")
    origins = tables.nodes(s, d).where("kind = 'Symbol' and lower(name) like 'release%'").select("uid")
    return graph.reach(e, origins, 2, ["CALLS"], "in").groupBy("distance").agg(F.count(F.lit(1)).alias("nodes"), F.min("uid").alias("first"))


def impact_of_symbol(s: SparkSession, d: str) -> DataFrame:
    """Callers of everything that is named like the first release symbol, with distance and confidence."""
    e = cut(tables.edges(s, d))
    origins = tables.nodes(s, d).where("kind = 'Symbol' and lower(name) like 'release%'").select("uid")
    return graph.impact(e, origins).select("uid", "distance", F.round("confidence", 4).alias("confidence"), "how")


def spread_two_hops(s: SparkSession, d: str) -> DataFrame:
    e = cut(tables.edges(s, d))
    seeds = tables.nodes(s, d).where("kind = 'Symbol' and lower(name) like '%approval%'").select("uid", F.lit(1.0).alias("score"))
    return graph.spread(e, seeds).select("uid", F.round("score", 4).alias("score"))


def flow_entries(s: SparkSession, d: str) -> DataFrame:
    e = cut(tables.edges(s, d))
    members = tables.nodes(s, d).where("kind = 'Symbol'").select("uid")
    return graph.entry_points(e, members)


def coverage_by_language(s: SparkSession, d: str) -> DataFrame:
    return graph.coverage_by_language(tables.nodes(s, d), cut(tables.edges(s, d)))


def report_scorecard(s: SparkSession, d: str) -> DataFrame:
    return answers.report(tables.nodes(s, d), cut(tables.edges(s, d)))


def preflight_risk(s: SparkSession, d: str) -> DataFrame:
    """For each file with symbols, how many files call into it, and the risk of changing it."""
    e = cut(tables.edges(s, d)).where("kind = 'CALLS'")
    at = tables.nodes(s, d).select("uid", "path")
    into = e.join(at.select(F.col("uid").alias("dst"), "path"), "dst").join(at.select(F.col("uid").alias("src"), F.col("path").alias("other")), "src").where("other <> path")
    counted = into.groupBy("path").agg(F.count_distinct("other").alias("dependants"))
    return counted.select("path", "dependants", answers.risk(F.lit(0), F.col("dependants"), F.lit(0)).alias("risk"))


def canonical_dump(s: SparkSession, d: str) -> DataFrame:
    return graph.canonical_dump(tables.nodes(s, d), tables.edges(s, d))


def term_prior(s: SparkSession, d: str) -> DataFrame:
    present = pick(table(s, d, "discovered"), "repo", "path").where("path is not null")
    return history.term_prior(table(s, d, "commits"), present)


def section_bodies(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "sections"), "section_id", "title", "body")
    return rows.groupBy("section_id").agg(F.concat_ws(" ", F.max("title"), F.max("body")).alias("body"))


def search_scripts(s: SparkSession, d: str) -> DataFrame:
    """Sections in which words of several scripts stand, with or without their accents."""
    store = search.PostingStore(s, scratch_path(s, "words"), "section_id").write(search.word_postings(section_bodies(s, d), "section_id", "body"))
    return store.search(["phê duyệt", "verkäufer", "주문은", "ลูกค้า", "Approvals", "après"])


def stored_bm25(s: SparkSession, d: str) -> DataFrame:
    """The same ranking as ``bm25_topk``, from postings that were stored once."""
    docs = table(s, d, "documents").where("text is not null")
    return search.PostingStore(s, scratch_path(s, "postings"), "doc_id").write(search.postings(docs, "doc_id", "text")).bm25(WORDS)


def prior_topk(s: SparkSession, d: str) -> DataFrame:
    return history.prior_for(term_prior(s, d), ["approval", "discount", "balance"])


def ground_labels(s: SparkSession, d: str) -> DataFrame:
    index = concepts.grounding_index(tables.nodes(s, d))
    labels = s.createDataFrame([(x, x.split()) for x in LABELS], "label string, words array<string>")
    return concepts.ground(labels, index)


def code_phrases(s: SparkSession, d: str) -> DataFrame:
    return concepts.code_phrases(tables.nodes(s, d).where("kind = 'Symbol'"), share=0.5)


def heading_concepts(s: SparkSession, d: str) -> DataFrame:
    """Concepts of the last parts of section slugs, whose words are those of the code."""
    heads = pick(table(s, d, "sections"), "slug").select(F.translate(F.substring_index("slug", ".", -1), "-", " ").alias("title")).distinct()
    return concepts.heading_concepts(heads, concepts.grounding_index(tables.nodes(s, d)))


def symbol_bodies(s: SparkSession, d: str) -> DataFrame:
    """(uid, name, path, line_start, documentation, body) of each symbol whose file is there, with its lines of the file."""
    symbols = tables.nodes(s, d).where("kind = 'Symbol' and line_start > 0 and line_end >= line_start").select("uid", F.coalesce("name", F.lit("")).alias("name"), "path", "line_start", "line_end")
    text = tables.files(s, d).where("content is not null").select("path", F.split("content", "\n").alias("lines"))
    own = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return symbols.join(text, "path").select("uid", "name", "path", "line_start", F.lit(None).cast("string").alias("documentation"), own.alias("body"))


def mined_rules(s: SparkSession, d: str) -> DataFrame:
    """Rules that sections, documentations, names of tests and guards state, each once for its anchor, with corroboration."""
    sec = pick(table(s, d, "sections"), "section_id", "path", "line_no", "body").where("body is not null")
    sec = sec.groupBy("section_id").agg(F.max(F.struct("body", "path", "line_no")).alias("r")).select("section_id", "r.*")
    docs = rules.mine_documents(sec.select(F.concat(F.lit("doc:"), F.col("section_id").cast("string")).alias("uid"), "path", "line_no", "body"))
    told = pick(table(s, d, "why_answers"), "location", "documentation").where("location is not null").groupBy("location").agg(F.max("documentation").alias("documentation"))
    told = told.select(F.concat(F.lit("at:"), "location").alias("uid"), F.lit("").alias("name"), F.lit("code").alias("path"), F.lit(0).alias("line_start"), "documentation", F.lit("").alias("body"))
    code = rules.mine_code(told).unionByName(rules.mine_code(symbol_bodies(s, d)))
    return rules.corroborate(rules.distinct_rules(cut(docs.unionByName(code))))


def rule_conflicts(s: SparkSession, d: str) -> DataFrame:
    return rules.conflicts(cut(mined_rules(s, d))).select("documented_claim", "observed_claim", "subject", "shared")


def corroborated(s: SparkSession, d: str) -> DataFrame:
    return mined_rules(s, d).select("claim", "corroborated", "confidence", "status")


def rule_listing(s: SparkSession, d: str) -> DataFrame:
    return rules.strong_rules(mined_rules(s, d)).select("rule", "subject", "polarity", "source", "anchor", "location", "confidence")


def _staged_rules(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sure = cut(mined_rules(s, d))
    return rules.staged(sure, cut(rules.conflicts(sure)))


def rule_nodes(s: SparkSession, d: str) -> DataFrame:
    return _staged_rules(s, d)[0].select("uid", "name")


def rule_edges(s: SparkSession, d: str) -> DataFrame:
    return _staged_rules(s, d)[1].select("src", "dst", "kind").distinct().groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))


def rule_evidence(s: SparkSession, d: str) -> DataFrame:
    return _staged_rules(s, d)[2].distinct()


def _section_sentences(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "sections"), "section_id", "body").where("body is not null")
    return rows.groupBy("section_id").agg(T.sentences(F.max("body")).alias("said"))


def claim_sentences(s: SparkSession, d: str) -> DataFrame:
    """How many sentences each section has, and how many of them can be checked and oblige or exempt."""
    count = lambda test: F.size(F.filter("said", test)).cast("long")
    return _section_sentences(s, d).select("section_id", F.size("said").cast("long").alias("sentences"), count(T.is_checkable).alias("checkable"), count(T.has_modal).alias("modal"))


def phrase_subjects(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "sections"), "body").where("body is not null").select(F.explode(T.sentences("body")).alias("c")).select(T.classify_phrase("c").alias("said"))
    return rows.where("said is not null").groupBy(F.concat_ws("|", "said.subject", "said.polarity").alias("said")).agg(F.count(F.lit(1)).alias("sentences"))


def human_names(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "nodes"), "name").where("name is not null").distinct()
    return rows.select("name", T.humanise("name").alias("words"))


def rules_by_side(s: SparkSession, d: str) -> DataFrame:
    return mined_rules(s, d).groupBy("source", "subject", "polarity").agg(F.count(F.lit(1)).alias("rules"), F.round(F.max("confidence"), 4).alias("confidence"))


def table_access(s: SparkSession, d: str) -> DataFrame:
    return extract.table_access(tables.files(s, d).where("lang = 'sql'")).select("path", "table", "access")


def declared_symbols(s: SparkSession, d: str) -> DataFrame:
    return extract.symbols(tables.files(s, d)).groupBy("lang", "what").agg(F.count(F.lit(1)).alias("declared"))


def repo_fingerprint(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "discovered"), "repo", "path", "hash").where("hash is not null").distinct()
    return rows.groupBy("repo").agg(T.fingerprint(F.concat_ws(" ", "path", F.lower("hash"))).alias("fingerprint"))


def merge_regions(s: SparkSession, d: str) -> DataFrame:
    """Each user's events, an hour around each, joined where less than two hours lie between."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = pick(table(s, d, "events"), "user_id", "ts").select("user_id", (seconds - 3600).alias("a"), (seconds + 3600).alias("b"))
    return budget.merge_regions(spans, ["user_id"], "a", "b", 7200)


def retrieval_offers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Offers of two simple arms for commits: partners of the first file by how often, and by path."""
    c = history.commits(table(s, d, "commits")).where(F.size("files").between(2, 6)).select(F.col("sha").alias("task"), "repo", F.array_sort("files").alias("f"))
    asked = c.select("task", "repo", F.get("f", 0).alias("q"), F.explode(F.expr("slice(f, 2, size(f))")).alias("path"))
    pairs = cut(history.co_changes(table(s, d, "commits")))
    both = pairs.select("repo", F.col("path_a").alias("q"), F.col("path_b").alias("path"), "support").unionByName(pairs.select("repo", F.col("path_b").alias("q"), F.col("path_a").alias("path"), "support"))
    often = F.row_number().over(Window.partitionBy("repo", "q").orderBy(F.desc("support"), "path"))
    named = F.row_number().over(Window.partitionBy("repo", "q").orderBy("path"))
    arms = both.select("repo", "q", "path", F.lit("often").alias("condition"), often.alias("place")).unionByName(both.select("repo", "q", "path", F.lit("named").alias("condition"), named.alias("place"))).where("place <= 5")
    offers = asked.select("task", "repo", "q").distinct().join(arms, ["repo", "q"]).select("task", "condition", "path", "place", F.length("path").cast("long").alias("tokens"))
    return offers, asked.select("task", "path")


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return evaluate.score_outcomes(*retrieval_offers(s, d))


def tasks(s: SparkSession, d: str) -> DataFrame:
    present = pick(table(s, d, "discovered"), "repo", "path").where("path is not null").distinct()
    return evaluate.tasks_from_history(table(s, d, "commits"), present)


def hit_interval(s: SparkSession, d: str) -> DataFrame:
    summary = evaluate.summarise(outcomes(s, d)).select("condition", "tasks", "tasks_with_a_hit")
    low, high = evaluate.wilson(F.col("tasks_with_a_hit"), F.col("tasks"))
    return summary.select("condition", low.alias("low"), high.alias("high"))


def budget_select(s: SparkSession, d: str) -> DataFrame:
    """What a small budget takes of the symbols of each language."""
    n = tables.nodes(s, d).where("kind = 'Symbol'")
    rows = n.select(F.col("lang").alias("query"), "uid", "kind", F.col("confidence").alias("score"), "tokens", F.lit(False).alias("conflicted"))
    return budget.select_each(budget.contenders(rows, 800), 800)


def context_answer(s: SparkSession, d: str) -> DataFrame:
    """The nodes a context for one task takes, in order."""
    found = answers.context(tables.nodes(s, d), cut(tables.edges(s, d)), tables.files(s, d), term_prior(s, d), "fix approval discount of the warehouse order")
    return s.createDataFrame([(i, r["uid"], r["kind"], float(r["score"]), int(r["tokens"])) for i, r in enumerate(found["taken"])], "place int, uid string, kind string, score double, tokens int")


def event_stream(s: SparkSession, d: str) -> DataFrame:
    """Daily counts of the events, read as a stream to its end."""
    rows = table(s, d, "events")
    return listings.run_stream(s, f"{d}/events.parquet*", rows.schema, lambda x: listings.event_counts(x, "1 day"))


def queries() -> dict[str, Query]:
    return {
        "p2_found": lambda s, d: incremental.replay_changes(table(s, d, "files"), table(s, d, "index_runs")),
        "bm25_topk": _bm25,
        "bm25_coverage_rank": bm25_coverage_rank,
        "substring_fallback": substring_fallback,
        "content_scan": lambda s, d: search.content_scan(tables.files(s, d), "path", "content", WORDS, 50),
        "path_scan": lambda s, d: search.path_scan(tables.files(s, d), "path", ["tax", "order", "approve"], 40),
        "file_aggregate_top3": file_aggregate_top3,
        "offer_cutoff": offer_cutoff,
        "pack_context": pack_context,
        "token_totals": token_totals,
        "text_functions": text_functions,
        "subject_words": subject_words,
        "path_predicates": path_predicates,
        "file_skip_summary": file_skip_summary,
        "changed_files": changed_files,
        "stat_skip": stat_skip,
        "node_upsert": node_upsert,
        "kind_counts": lambda s, d: graph.kind_counts(tables.nodes(s, d)),
        "innermost_span": innermost_span,
        "nesting": nesting,
        "resolve_refs": resolve_refs,
        "unresolved": unresolved,
        "impact_reach": impact_reach,
        "impact_of_symbol": impact_of_symbol,
        "spread_two_hops": spread_two_hops,
        "flow_entries": flow_entries,
        "coverage_by_language": coverage_by_language,
        "report_scorecard": report_scorecard,
        "preflight_risk": preflight_risk,
        "canonical_dump": canonical_dump,
        "co_change": lambda s, d: history.co_changes(table(s, d, "commits")),
        "term_prior": term_prior,
        "search_scripts": search_scripts,
        "stored_bm25": stored_bm25,
        "prior_topk": prior_topk,
        "recent_per_file": lambda s, d: history.recent_commits(table(s, d, "commits")),
        "introduced_by": lambda s, d: history.introduced_by(table(s, d, "commits")),
        "commits_by_file": lambda s, d: history.commits_by_file(table(s, d, "commits")),
        "ground_labels": ground_labels,
        "code_phrases": code_phrases,
        "heading_concepts": heading_concepts,
        "mined_rules": rules_by_side,
        "rule_conflicts": rule_conflicts,
        "corroborate": corroborated,
        "rule_listing": rule_listing,
        "rule_nodes": rule_nodes,
        "rule_edges": rule_edges,
        "rule_evidence": rule_evidence,
        "claim_sentences": claim_sentences,
        "phrase_subjects": phrase_subjects,
        "human_names": human_names,
        "table_access": table_access,
        "declared_symbols": declared_symbols,
        "repo_fingerprint": repo_fingerprint,
        "merge_regions": merge_regions,
        "score_outcomes": outcomes,
        "summary_mrr": lambda s, d: evaluate.summarise(outcomes(s, d)),
        "paired": lambda s, d: evaluate.paired(cut(outcomes(s, d)), "often", "named"),
        "losses": lambda s, d: evaluate.losses(cut(outcomes(s, d)), "named", "often"),
        "expected_tokens": lambda s, d: evaluate.expected_tokens(outcomes(s, d), 4000),
        "hit_interval": hit_interval,
        "tasks_from_history": tasks,
        "budget_select": budget_select,
        "context_answer": context_answer,
        "event_stream": event_stream,
    } | function_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | RULE_ORACLES | function_queries.SQL
