"""The typed property graph: staging, lookups, neighbours, spread and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import lexicon as lex
from quarrylens.functions import text as T
from quarrylens.runtime import cut

NODE_COLUMNS = ["kind", "name", "path", "line_start", "line_end", "lang", "payload"]


def status_rank(status: Column) -> Column:
    """Place of a status from weakest to strongest; unknown ones are weakest."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in lex.STATUS_ORDER]), status), F.lit(1))


def upsert_nodes(staged: DataFrame, order: str) -> DataFrame:
    """One node for each uid: the latest attributes, the greatest confidence and the status that came with it.

    ``order`` tells later rows from earlier ones. Among equal confidences the later status holds.
    """
    latest = F.max_by(F.struct(*NODE_COLUMNS), F.struct(order, *NODE_COLUMNS)).alias("n")
    return (
        staged.where("uid is not null")
        .groupBy("uid")
        .agg(latest, F.max_by("status", F.struct("confidence", order, "status")).alias("status"), F.max("confidence").alias("confidence"))
        .select("uid", "n.*", "status", "confidence")
        .withColumn("tokens", T.token_estimate(T.preview(F.col("kind"), F.col("name"), F.col("path"), F.col("payload"))))
    )


def upsert_edges(staged: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """One edge for each (src, dst, kind) whose ends exist: first status, greatest confidence; loops only for calls."""
    ends = nodes.select("uid")
    known = staged.join(ends.withColumnRenamed("uid", "src"), "src", "left_semi").join(ends.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return (
        known.where((F.col("src") != F.col("dst")) | (F.col("kind") == "CALLS"))
        .groupBy("src", "dst", "kind")
        .agg(F.min_by("status", F.struct(order, "status")).alias("status"), F.max("confidence").alias("confidence"))
    )


def unresolved_edges(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged edges with an end that no node has."""
    ends = nodes.select("uid")
    return staged.join(ends.withColumnRenamed("uid", "src"), "src", "left_anti").unionByName(
        staged.join(ends.withColumnRenamed("uid", "src"), "src", "left_semi").join(ends.withColumnRenamed("uid", "dst"), "dst", "left_anti")
    )


def nodes_of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind).orderBy("name", "uid")


def symbols_in(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("kind") == "Symbol") & (F.col("path") == path)).orderBy("line_start", "uid")


def symbols_named(nodes: DataFrame, name: str, most: int = 64) -> DataFrame:
    return nodes.where((F.col("kind") == "Symbol") & (F.col("name") == name)).orderBy("uid").limit(most)


def distinct_names(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Names of the symbols in the given paths."""
    return nodes.where("kind = 'Symbol'").join(paths.select("path"), "path", "left_semi").select("name").distinct()


#: Lines of a file that share a bucket in interval joins.
LINE_BUCKET = 256


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (path, line) the shortest span of its path that covers it; ties take the least uid.

    Spans are listed under every bucket of lines they touch, so the join is on equal keys.
    """
    listed = spans.where("path is not null and line_end >= line_start").select(
        "path", F.col("uid").alias("span_uid"), "line_start", "line_end",
        F.explode(F.sequence(F.floor(F.col("line_start") / LINE_BUCKET), F.floor(F.col("line_end") / LINE_BUCKET))).alias("__bucket"),
    )
    keyed = points.withColumn("__bucket", F.floor(F.col("line") / LINE_BUCKET))
    hit = keyed.join(listed, ["path", "__bucket"]).where("line between line_start and line_end")
    return hit.groupBy(*points.columns).agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "span_uid")).alias("m")).select(*points.columns, F.col("m.span_uid").alias("uid"))


def nesting(nodes: DataFrame) -> DataFrame:
    """(src, dst) from each symbol to the symbols directly inside it."""
    spans = nodes.where("kind = 'Symbol'").select("uid", "path", "line_start", "line_end").dropDuplicates(["uid"])
    outer = spans.select(
        "path", F.col("uid").alias("src"), F.col("line_start").alias("a"), F.col("line_end").alias("b"),
        F.explode(F.sequence(F.floor(F.col("line_start") / LINE_BUCKET), F.floor(F.col("line_end") / LINE_BUCKET))).alias("__bucket"),
    )
    inner = spans.select("path", F.col("uid").alias("dst"), "line_start", "line_end", F.floor(F.col("line_start") / LINE_BUCKET).alias("__bucket"))
    inside = (F.col("src") != F.col("dst")) & (F.col("a") <= F.col("line_start")) & (F.col("b") >= F.col("line_end")) & ((F.col("a") < F.col("line_start")) | (F.col("b") > F.col("line_end")))
    hit = inner.join(outer, ["path", "__bucket"]).where(inside)
    return hit.groupBy("dst").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("size"), "src")).alias("m")).select("m.src", "dst")


def neighbours(edges: DataFrame, frontier: DataFrame, kinds: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(origin, uid, kind, confidence, outgoing) of the edges at the frontier's nodes."""
    live = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    parts = []
    if direction in ("out", "both"):
        parts.append(live.join(frontier.select(F.col("uid").alias("src")), "src", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("uid"), "kind", "confidence", F.lit(True).alias("outgoing")))
    if direction in ("in", "both"):
        parts.append(live.join(frontier.select(F.col("uid").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("origin"), F.col("src").alias("uid"), "kind", "confidence", F.lit(False).alias("outgoing")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def edge_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, w in lex.EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(w))]), kind), F.lit(0.0))


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.55, floor: float = 0.02) -> DataFrame:
    """(uid, score): relevance passed over edges in both directions, the greatest of all ways.

    Rounds are synchronous: a hop passes on only what improved in the hop before it.
    """
    scores = seeds.groupBy("uid").agg(F.max("score").alias("score"))
    frontier = scores
    for hop in range(hops):
        reached = neighbours(edges, frontier, lex.SPREAD_KINDS).join(frontier.select(F.col("uid").alias("origin"), F.col("score").alias("from_score")), "origin")
        passed = F.col("from_score") * edge_weight(F.col("kind")) * F.col("confidence") * F.lit(decay**hop)
        new = reached.select("uid", passed.alias("score")).where(F.col("score") >= floor).groupBy("uid").agg(F.max("score").alias("score"))
        old = scores.withColumnRenamed("score", "old")
        frontier = cut(new.join(old, "uid", "left").where("old is null or score > old").drop("old"))
        scores = scores.unionByName(frontier).groupBy("uid").agg(F.max("score").alias("score"))
    return scores


def reach(edges: DataFrame, origins: DataFrame, depth: int = 2, kinds: list[str] | None = None, direction: str = "in") -> DataFrame:
    """(uid, distance) of the nodes within ``depth`` steps, by rounds; origins have distance 0."""
    seen = origins.select("uid", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        step = neighbours(edges, frontier, kinds, direction).select("uid").distinct()
        frontier = cut(step.join(seen, "uid", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def data_coupled(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(uid, through): others that read or write a table the origins read or write."""
    access = edges.where(F.col("kind").isin("READS", "WRITES")).select("src", "dst")
    tables = access.join(origins.select(F.col("uid").alias("src")), "src", "left_semi").select("dst").distinct()
    others = access.join(tables, "dst").join(origins.select(F.col("uid").alias("src")), "src", "left_anti")
    return others.groupBy(F.col("src").alias("uid")).agg(F.min("dst").alias("through"))


def impact(edges: DataFrame, origins: DataFrame, depth: int = 2, most: int = 60) -> DataFrame:
    """(uid, distance, confidence, how): callers within ``depth`` and, not followed further, sharers of tables."""
    calls = edges.where("kind = 'CALLS'")
    callers = reach(calls, origins, depth, ["CALLS"]).where("distance > 0")
    best = neighbours(calls, reach(calls, origins, depth, ["CALLS"]), ["CALLS"], "in").groupBy("uid").agg(F.max("confidence").alias("confidence"))
    called = callers.join(best, "uid").select("uid", "distance", "confidence", F.lit("calls").alias("how"))
    shared = data_coupled(edges, origins).select("uid", F.lit(1).alias("distance"), F.lit(0.8).alias("confidence"), F.lit("data").alias("how"))
    both = called.unionByName(shared).groupBy("uid").agg(F.min(F.struct("distance", (-F.col("confidence")).alias("c"), "how")).alias("m"))
    return both.select("uid", "m.distance", (-F.col("m.c")).alias("confidence"), "m.how").orderBy("distance", F.desc("confidence"), "uid").limit(most)


def entry_points(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Members that no other member calls."""
    inside = edges.where("kind = 'CALLS' and src <> dst").join(members.select(F.col("uid").alias("src")), "src", "left_semi")
    return members.join(inside.select(F.col("dst").alias("uid")), "uid", "left_anti")


def flow(edges: DataFrame, members: DataFrame, most: int = 16) -> DataFrame:
    """(uid, level): members in the order calls reach them from the entry points, then those no entry reaches."""
    inside = edges.where("kind = 'CALLS' and src <> dst").join(members.select(F.col("uid").alias("src")), "src", "left_semi").join(members.select(F.col("uid").alias("dst")), "dst", "left_semi")
    levels = reach(inside, entry_points(edges, members), most, ["CALLS"], "out").withColumnRenamed("distance", "level")
    rest = members.select("uid").join(levels, "uid", "left_anti").withColumn("level", F.lit(most + 1))
    return levels.unionByName(rest).orderBy("level", "uid").limit(most)


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


def coverage_by_language(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(lang, files, covered) with a TOTAL row: a file is covered when an edge from another file enters one of its nodes."""
    at = nodes.select("uid", "path")
    entered = (
        edges.join(at.select(F.col("uid").alias("src"), F.col("path").alias("src_path")), "src")
        .join(at.select(F.col("uid").alias("dst"), "path"), "dst")
        .where("src_path <> path")
        .select("path")
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    files = nodes.where("kind = 'File' and path is not null").groupBy("path").agg(F.max("lang").alias("lang")).join(entered, "path", "left")
    counted = files.rollup("lang").agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("covered"), F.grouping("lang").alias("all_langs"))
    return counted.select(F.when(F.col("all_langs") == 1, "TOTAL").otherwise(F.col("lang")).alias("lang"), "files", "covered", F.round(F.col("covered") / F.col("files"), 4).alias("share"))


def canonical_dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted tab-separated lines of all nodes and edges, confidence to four digits."""
    rounded = F.format_string("%.4f", F.col("confidence").cast("double"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = nodes.select(F.concat_ws("\t", F.lit("N"), *[text(c) for c in ("uid", "kind", "name", "path", "line_start", "line_end", "lang", "status")], rounded).alias("line"))
    e = edges.select(F.concat_ws("\t", F.lit("E"), *[text(c) for c in ("src", "dst", "kind", "status")], rounded).alias("line"))
    return n.unionByName(e).orderBy("line")
