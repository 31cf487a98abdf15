"""The graph over the indexer's tables, and SQL views of everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import graph, history, resolve
from quarrylens.runtime import cut, pick, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings files discovered index_runs index_reports commits file_extracts sections nodes why_answers mix_targets".split()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each node once, as stored last."""
    rows = pick(table(spark, d, "nodes"), "node_id", "uid", "kind", "name", "path", "line_start", "line_end", "lang", "status", "confidence", "payload")
    return graph.upsert_nodes(rows, "node_id")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, lang, content) of each present file once."""
    rows = pick(table(spark, d, "discovered"), "repo", "path", "lang", "mtime", "content").where("path is not null")
    return rows.groupBy("repo", "path").agg(F.max(F.struct("mtime", "content", "lang")).alias("r")).select("repo", "path", "r.lang", "r.content")


def call_references(spark: SparkSession, d: str) -> DataFrame:
    """(from_uid, name, path, lang, kind) of the names files use before a bracket."""
    found = files(spark, d).where("content is not null").select("path", "lang", F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))).alias("names"))
    return found.select(F.concat(F.lit("file:"), "path").alias("from_uid"), F.explode("names").alias("name"), "path", "lang", F.lit("CALLS").alias("kind"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, status, confidence): nesting, calls and pairs changed together."""
    n = nodes(spark, d)
    inside = graph.nesting(n).select("src", "dst", F.lit("CALLS").alias("kind"), F.lit("CONFIRMED").alias("status"), F.lit(0.5).alias("confidence"))
    symbols = n.where("kind = 'Symbol'")
    calls = resolve.resolve_references(call_references(spark, d), symbols).select(F.col("from_uid").alias("src"), F.col("uid").alias("dst"), "kind", "status", "confidence")
    pairs = history.co_changes(table(spark, d, "commits")).select(F.concat(F.lit("file:"), "path_a").alias("src"), F.concat(F.lit("file:"), "path_b").alias("dst"), F.lit("CO_CHANGES_WITH").alias("kind"), F.lit("OBSERVED").alias("status"), "confidence")
    staged = inside.unionByName(calls).unionByName(pairs)
    return graph.upsert_edges(staged, n, "confidence")


def register_views(spark: SparkSession, d: str) -> list[str]:
    """Views of the source tables, ``graph_nodes`` and ``graph_edges``, so Spark SQL is the language for everything else."""
    for name in TABLES:
        table(spark, d, name).createOrReplaceTempView(name)
    nodes(spark, d).createOrReplaceTempView("graph_nodes")
    cut(edges(spark, d)).createOrReplaceTempView("graph_edges")
    return [*TABLES, "graph_nodes", "graph_edges"]
