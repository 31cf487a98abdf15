"""Answers over the graph: why, impact, explain, flow, preflight, report and context.

Each answer is a dictionary of frames, one for each section; nothing is collected but
the bounded lists that a budget is spent on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import budget as B
from quarrylens.operators import graph, history, ranking, search
from quarrylens.runtime import cut

WHY_MOST, IMPACT_MOST = 8, 60


def resolve_target(nodes: DataFrame, target: str, most: int = 6) -> DataFrame:
    """(uid) a target means: a uid, the innermost symbol at path:line, a file, a name, else names holding its words."""
    exact = nodes.where(F.col("uid") == target).select("uid")
    if not exact.isEmpty():
        return exact
    if m := re.fullmatch(r"(.*):(\d+)", target):
        point = nodes.sparkSession.createDataFrame([(m[1], int(m[2]))], "path string, line int")
        spot = graph.innermost(nodes.where("kind = 'Symbol'"), point).select("uid")
        if not spot.isEmpty():
            return spot
    for rows in (nodes.where((F.col("kind") == "File") & (F.col("path") == target)), graph.symbols_named(nodes, target)):
        if not rows.isEmpty():
            return rows.select("uid").limit(most)
    words = F.array(*[F.lit(w) for w in re.findall(r"\w{3,}", target.lower())] or [F.lit("")])
    near = nodes.where("kind = 'Symbol'").select("uid", T.coverage(words, T.split_identifier("name")).alias("c")).where("c > 0")
    return near.orderBy(F.desc("c"), "uid").limit(most).select("uid")


def why(nodes: DataFrame, edges: DataFrame, answers: DataFrame, target: str) -> dict[str, DataFrame]:
    """The node, what documents it, what it calls and who calls it, the data it touches and what it changes with."""
    at = resolve_target(nodes, target)
    near = graph.neighbours(edges, at).join(nodes.select("uid", "name", "path"), "uid")
    part = lambda kinds, out: near.where(F.col("kind").isin(kinds) & (F.col("outgoing") == out)).select("uid", "name", "path", "kind", "confidence").orderBy(F.desc("confidence"), "uid").limit(WHY_MOST)
    node = nodes.join(at, "uid", "left_semi")
    told = answers.join(node.select(F.concat_ws(":", "path", F.col("line_start").cast("string")).alias("location")), "location", "left_semi")
    return {
        "node": node, "documents": told, "calls": part(["CALLS"], True), "callers": part(["CALLS"], False), "reads": part(["READS"], True), "writes": part(["WRITES"], True),
        "concepts": part(["MAPS_TO"], False), "rules": part(["IMPLEMENTS_RULE"], True), "history": part(["INTRODUCED_BY", "CHANGED_BY"], True),
        "co_changes": near.where("kind = 'CO_CHANGES_WITH'").select("uid", "name", "confidence").orderBy(F.desc("confidence"), "uid").limit(WHY_MOST),
    }


def impact(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2) -> DataFrame:
    """(uid, name, path, distance, confidence, how) of what depends on a target."""
    return graph.impact(edges, resolve_target(nodes, target), depth, IMPACT_MOST).join(nodes.select("uid", "name", "path"), "uid").orderBy("distance", F.desc("confidence"), "uid")


def explain(nodes: DataFrame, edges: DataFrame, concept: str) -> dict[str, DataFrame]:
    """What a concept maps to, and the tables, rules and callers one step further."""
    at = nodes.where((F.col("kind") == "Concept") & (F.col("uid") == f"concept:{concept}")).select("uid")
    targets = graph.neighbours(edges, at, ["MAPS_TO"], "out").select("uid").distinct()
    beyond = graph.neighbours(edges, targets, ["CALLS", "READS", "WRITES", "IMPLEMENTS_RULE"])
    named = lambda rows: rows.join(nodes, "uid", "left_semi").select("uid", "kind", "name", "path")
    return {"targets": nodes.join(targets, "uid", "left_semi").select("uid", "kind", "name", "path"), **{k: nodes.join(beyond.where(F.col("kind").isin(kinds)).select("uid").distinct(), "uid", "left_semi").select("uid", "kind", "name", "path") for k, kinds in (("data", ["READS", "WRITES"]), ("rules", ["IMPLEMENTS_RULE"]), ("callers", ["CALLS"]))}}


def flow(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """(uid, level, name, path): the order in which calls reach what belongs to a target."""
    at = resolve_target(nodes, target)
    members = graph.neighbours(edges, at, ["CALLS"]).select("uid").union(at).distinct().join(nodes.where("kind = 'Symbol'").select("uid"), "uid", "left_semi")
    return graph.flow(edges, members).join(nodes.select("uid", "name", "path"), "uid").orderBy("level", "uid")


def risk(conflicts, dependants, rules):
    """HIGH with a conflict, ten dependants or five rules; MEDIUM with a rule or three dependants."""
    return F.when((conflicts > 0) | (dependants >= 10) | (rules >= 5), "HIGH").when((rules > 0) | (dependants >= 3), "MEDIUM").otherwise("LOW")


def preflight(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """One row for a file about to change: concepts, tables, outside dependants, rules, conflicts and risk."""
    inside = nodes.where(F.col("path") == path).select("uid")
    near = graph.neighbours(edges, inside).join(nodes.select("uid", F.col("path").alias("other")), "uid")
    count = lambda cond: F.count_distinct(F.when(cond, F.col("uid")))
    outside = F.coalesce(F.col("other") != path, F.lit(True))
    row = near.agg(
        count(F.col("kind") == "MAPS_TO").alias("concepts"), count(F.col("kind").isin("READS", "WRITES")).alias("tables"), count((F.col("kind") == "CALLS") & ~F.col("outgoing") & outside).alias("dependants"),
        count(F.col("kind") == "IMPLEMENTS_RULE").alias("rules"), count(F.col("kind") == "CONTRADICTS").alias("conflicts"),
    )
    return row.withColumn("risk", risk(F.col("conflicts"), F.col("dependants"), F.col("rules")))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts over the graph and the share of symbols some text or rule speaks of."""
    known = edges.where(F.col("kind").isin("DOCUMENTED_BY", "IMPLEMENTS_RULE", "MAPS_TO"))
    told = known.select(F.col("src").alias("uid")).union(known.select(F.col("dst").alias("uid"))).distinct().withColumn("told", F.lit(True))
    n = nodes.join(told, "uid", "left")
    counts = n.agg(
        *[F.count_if(F.col("kind") == k).alias(a) for k, a in (("File", "files"), ("Symbol", "symbols"), ("DocSection", "sections"), ("Concept", "concepts"), ("DatabaseObject", "tables"), ("BusinessRule", "rules"), ("Commit", "commits"))],
        F.round(F.coalesce(F.try_divide(F.count_if((F.col("kind") == "Symbol") & F.col("told")), F.count_if(F.col("kind") == "Symbol")), F.lit(0.0)), 4).alias("documented_share"),
    )
    return counts.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))


def concept_expansion(nodes: DataFrame, index: DataFrame, seeds: DataFrame, words: list[str], most: int = 3, each: int = 15, decay: float = 0.5) -> DataFrame:
    """(uid, score, reason): what the other words of the best seeded concepts find, at ``decay`` of the concept's score."""
    top = seeds.groupBy("uid").agg(F.max("score").alias("score")).join(nodes.where("kind = 'Concept'").select("uid", "name"), "uid")
    novel = F.array_except(T.meaningful_words(F.concat_ws(" ", "name", F.translate(F.substring_index("uid", ":", -1), "_", " "))), F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    out = nodes.sparkSession.createDataFrame([], "uid string, score double, reason string")
    for r in top.select("name", "score", novel.alias("novel")).where(F.size("novel") > 0).orderBy(F.desc("score"), "name").limit(most).collect():  # at most three rows
        found = search.prefix_search(index, "uid", list(r.novel), most=each)
        best = found.agg(F.max("score").alias("best"))
        out = out.unionByName(found.crossJoin(F.broadcast(best)).select("uid", (F.lit(r.score * decay) * F.col("score") / F.col("best")).alias("score"), F.lit(f"uses the words of {r.name}").alias("reason")))
    return out


def search_texts(nodes: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(uid, body) to be searched: the words of a node's name and path, its summary, its claim, and its text in ``bodies`` (uid, text)."""
    said = [F.get_json_object("payload", f"$.{k}") for k in ("summary", "claim")]
    rows = nodes.select("uid", F.concat_ws(" ", "name", F.array_join(T.split_identifier("name"), " "), F.translate("path", "/_-.", "    "), *said).alias("own"))
    if bodies is None:
        return rows.withColumnRenamed("own", "body")
    return rows.join(bodies.select("uid", "text"), "uid", "left").select("uid", F.concat_ws(" ", "own", "text").alias("body"))


def context(nodes: DataFrame, edges: DataFrame, files: DataFrame, prior: DataFrame, task: str, budget: int = 4000, exclude: list[str] | None = None, bodies: DataFrame | None = None) -> dict:
    """What to read for a task within a budget of tokens.

    Seeds come from the words of the task in names, from identifiers it names, from file
    contents and from history; they spread over the graph; the best for their cost are
    taken, and the rest of the budget goes to a reading plan.
    """
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(task,)], "t string").select(T.meaningful_words("t").alias("w"), T.identifier_tokens("t").alias("i")).first()
    words, named = list(frame.w), list(frame.i)
    docs = search_texts(nodes, bodies)
    index = cut(search.word_postings(docs, "uid", "body"))
    found = search.prefix_search(index, "uid", words)
    if found.isEmpty():
        found = search.substring_search(docs, "uid", "body", words).select("uid", F.col("matched").cast("double").alias("score"))
    hits = found.withColumnRenamed("score", "relevance").join(nodes.select("uid", "kind", "name", "path", "confidence", "payload"), "uid")
    seeds = ranking.seed_scores(hits, words).unionByName(ranking.verbatim_scores(nodes.where("kind = 'Symbol'"), named, words))
    seeds = seeds.unionByName(concept_expansion(nodes, index, seeds, words))
    scan = search.content_scan(files, "path", "content", words)
    at_files = nodes.where("kind = 'File'").select("uid", "path")
    seeds = seeds.unionByName(at_files.join(scan, "path").select("uid", (F.col("score") * 0.6).alias("score"), F.lit("its text holds the words").alias("reason")))
    best = cut(ranking.bump(seeds))
    history_seeds = ranking.history_scores(history.prior_for(prior, words), nodes)
    summed = cut(ranking.boost(best.unionByName(history_seeds)))
    widened = cut(ranking.boost(summed.unionByName(ranking.fan_out(summed, nodes))))
    spread = graph.spread(edges, widened.select("uid", "score")).withColumn("reason", F.lit("related to what matches"))
    final = ranking.ranked(ranking.bump(widened.unionByName(spread)))
    rows = final.join(nodes.select("uid", "kind", "name", "path", "line_start", "line_end", "tokens"), "uid")
    rows = cut(rows)
    share = int(budget * B.ANSWER_SHARE)
    able = B.contenders(B.without(rows, exclude or []).withColumn("query", F.lit(task)).withColumn("conflicted", F.lit(False)), share)
    taken = B.select([r.asDict() for r in able.orderBy(F.desc("score"), "uid").collect()], share)  # bounded by the budget
    left = budget - sum(r["tokens"] for r in taken)
    regions = [{"path": r["path"], "start": r["line_start"], "end": r["line_end"]} for r in taken if r["kind"] == "Symbol" and r["path"] and (r["line_end"] or 0) >= (r["line_start"] or 0) > 0]
    return {"words": words, "taken": taken, "reading": B.reading_plan(regions, left), "files": ranking.offered(ranking.file_scores(rows)).orderBy(F.desc("score"), "path"), "unknowns": [] if taken else ["nothing in the graph matches the task"]}


def iterate(run, rounds: int = 3) -> list[dict]:
    """Several answers to one task, each without the files offered before: ``run(exclude)`` gives {"paths", "tokens"}."""
    offered: list[str] = []
    out, cost = [], 0
    for _ in range(rounds):
        answer = run(list(offered))
        cost += answer["tokens"]
        out.append(answer | {"cost": cost})
        offered += [p for p in answer["paths"] if p not in offered]
    return out
