"""Scores of nodes and files for a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T

# Weight of a node's kind among the seeds.
KIND_WEIGHTS = {"Concept": 1.0, "BusinessRule": 1.0, "DocSection": 0.9, "Symbol": 0.85, "DatabaseObject": 0.7, "File": 0.35, "Commit": 0.3}


def bump(scores: DataFrame) -> DataFrame:
    """Several scores of a uid become their greatest, with its reason."""
    return scores.groupBy("uid").agg(F.max("score").alias("score"), F.max_by("reason", F.struct("score", "reason")).alias("reason"))


def boost(scores: DataFrame) -> DataFrame:
    """Several scores of a uid become their sum, with the reason of the greatest."""
    return scores.groupBy("uid").agg(F.sum("score").alias("score"), F.max_by("reason", F.struct("score", "reason")).alias("reason"))


def seed_scores(hits: DataFrame, asked: list[str]) -> DataFrame:
    """(uid, score, reason): relevance as a share of the best, by kind, confidence, covered words and path.

    hits: uid, kind, name, path, confidence, relevance and, where there is one, payload. A node
    answers the words of its name, path and summary.
    """
    words = F.array(*[F.lit(w) for w in asked])
    weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in KIND_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(0.5))
    best = hits.agg(F.max("relevance").alias("best"))
    share = F.least(F.greatest(F.col("relevance") / F.col("best"), F.lit(0.0)), F.lit(1.0))
    summary = F.get_json_object("payload", "$.summary") if "payload" in hits.columns else F.lit(None).cast("string")
    own = T.meaningful_words(F.concat_ws(" ", "name", F.translate("path", "/.", "  "), summary))
    cover = T.coverage(words, own) if asked else F.lit(1.0)
    score = share * weight * F.col("confidence") * (0.35 + 0.65 * cover) * (1 + F.coalesce(T.path_affinity(words, "path"), F.lit(0.0)))
    return hits.crossJoin(F.broadcast(best)).select("uid", F.round(score, 6).alias("score"), F.lit("matches the words of the task").alias("reason"))


def verbatim_scores(symbols: DataFrame, task_tokens: list[str], words: list[str]) -> DataFrame:
    """(uid, score, reason): identifiers the task names, and words that are a symbol."""
    exact = symbols.where(F.col("name").isin(task_tokens)).select("uid", F.lit(1.2).alias("score"), F.lit("named in the task").alias("reason"))
    return exact.unionByName(symbols.where(F.lower("name").isin(words)).select("uid", F.lit(0.9).alias("score"), F.lit("its name is a word of the task").alias("reason")))


def history_scores(prior: DataFrame, nodes: DataFrame, weight: float = 0.9, each: int = 6) -> DataFrame:
    """(uid, score, reason): files by their share of the best prior, their first symbols by half of it."""
    best = prior.agg(F.max("score").alias("best"))
    files = prior.crossJoin(F.broadcast(best)).select("path", (F.lit(weight) * F.col("score") / F.col("best")).alias("score"))
    why = F.lit("changed for such tasks before").alias("reason")
    own = nodes.where("kind = 'File'").join(files, "path").select("uid", "score", why)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_start", "uid"))
    first = nodes.where("kind = 'Symbol'").join(files, "path").withColumn("rank", rank).where(F.col("rank") <= each)
    return own.unionByName(first.select("uid", (F.col("score") / 2).alias("score"), why))


def fan_out(scores: DataFrame, nodes: DataFrame, weight: float = 0.8, files: int = 6, each: int = 8) -> DataFrame:
    """(uid, score, reason): the best files pass on to their first symbols."""
    scored = nodes.where("kind = 'File'").select("uid", "path").join(scores.select("uid", "score"), "uid").orderBy(F.desc("score"), "uid").limit(files)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_start", "uid"))
    inside = nodes.where("kind = 'Symbol'").select("uid", "path", "line_start").join(F.broadcast(scored.select("path", "score")), "path")  # at most ``files`` rows
    return inside.withColumn("rank", rank).where(F.col("rank") <= each).select("uid", (F.col("score") * weight).alias("score"), F.lit("in a file that matches").alias("reason"))


def ranked(scores: DataFrame, floor: float = 0.02) -> DataFrame:
    return scores.where(F.col("score") >= floor).orderBy(F.desc("score"), "uid")


def file_scores(scores: DataFrame, key: str = "path", item: str = "uid", top: int = 3) -> DataFrame:
    """(key, score): the sum of a file's ``top`` scores."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), item))
    return scores.where(F.col(key).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= top).groupBy(key).agg(F.round(F.sum("score"), 4).alias("score"))


def offered(files: DataFrame, cutoff: float = 0.2) -> DataFrame:
    """Files with at least ``cutoff`` of the best score."""
    best = files.agg(F.max("score").alias("best"))
    return files.crossJoin(F.broadcast(best)).where(F.col("score") >= cutoff * F.col("best")).drop("best")
