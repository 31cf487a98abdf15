"""What the change history says: file pairs, terms of changed files, newest and oldest commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.runtime import cut, pick, salted_join


def commits(df: DataFrame) -> DataFrame:
    """(sha, repo, authored_ts, subject, change_class, files) of each commit once, by sha without letter case.

    The latest delivery counts; its class is read from the subject.
    """
    rows = pick(df, "sha", "repo", "authored_ts", "subject", "files", "ingested_at").where("sha is not null")
    one = rows.groupBy(F.lower("sha").alias("sha")).agg(F.max(F.struct("ingested_at", "repo", "authored_ts", "subject", "files")).alias("r"))
    return one.select("sha", "r.repo", "r.authored_ts", "r.subject", T.commit_class(F.coalesce("r.subject", F.lit(""))).alias("change_class"), F.array_distinct(F.coalesce("r.files", F.array().cast("array<string>"))).alias("files"))


def commit_files(df: DataFrame) -> DataFrame:
    return commits(df).select("sha", "repo", "authored_ts", "change_class", F.explode("files").alias("path"))


def co_changes(df: DataFrame, low: int = 2, high: int = 20, support: int = 3, most: int | None = None) -> DataFrame:
    """(repo, path_a, path_b, support, confidence): pairs changed together in commits of ``low`` to ``high`` files.

    All pairs, or with ``most`` the best of each repository.
    """
    small = commits(df).select("repo", F.array_sort("files").alias("f")).where(F.size("f").between(low, high))
    heads = small.select("repo", "f", F.posexplode("f").alias("at", "path_a"))
    pairs = heads.select("repo", "path_a", F.explode(F.expr("slice(f, at + 2, size(f))")).alias("path_b"))
    counted = pairs.groupBy("repo", "path_a", "path_b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    scored = counted.withColumn("confidence", F.round(F.least(0.4 + 0.05 * F.col("support"), F.lit(0.85)), 4))
    if most is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("support"), "path_a", "path_b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def co_changed_with(pairs: DataFrame, path: str) -> DataFrame:
    """Partners of a path, whichever side it is stored on."""
    left = pairs.where(F.col("path_a") == path).select(F.col("path_b").alias("path"), "support")
    return left.unionByName(pairs.where(F.col("path_b") == path).select(F.col("path_a").alias("path"), "support"))


def commit_terms(df: DataFrame, terms_each: int = 12, terms_with_body: int = 24, body_words: int = 80, most_files: int = 20) -> DataFrame:
    """(repo, terms, files): the stems of the words of each commit's subject, then of the first words of its body if there is one.

    Each stem counts once, up to ``terms_each`` of them, or ``terms_with_body``. Commits of more
    than ``most_files`` files are sweeps and say nothing.
    """
    named = commits(df).where((F.size("files") <= most_files)).select("sha", "repo", "subject", "files")
    told = F.array().cast("array<string>")
    if "body" in df.columns:
        bodies = pick(df, "sha", "body").where("sha is not null and body is not null").groupBy(F.lower("sha").alias("sha")).agg(F.max("body").alias("body"))
        named = named.join(bodies, "sha", "left")
        first = F.array_join(F.slice(F.filter(F.split("body", r"\s+"), lambda w: w != ""), 1, body_words), " ")
        told = F.coalesce(T.meaningful_words(first), told)
    stems = F.array_distinct(F.transform(F.concat(F.coalesce(T.meaningful_words("subject"), F.array().cast("array<string>")), told), T.stem))
    return named.select("repo", F.slice(stems, 1, F.when(F.size(told) > 0, F.lit(terms_with_body)).otherwise(F.lit(terms_each))).alias("terms"), "files")


def term_prior(df: DataFrame, present: DataFrame | None = None, per_term: int = 40, support: int = 2, **limits: int) -> DataFrame:
    """(term, path, n, score): how strongly a stem in commits points to a file.

    Only files of ``present`` (repo, path) count where it is given. Score: pointwise mutual
    information times ln(1 + n), of pairs with ``support`` uses and a positive information;
    margins count pairs before that filter. The ``per_term`` best files of each term are kept.
    Margins join through spread keys, so a term or file of a large share of all pairs is no
    partition of its own.
    """
    each = commit_terms(df, **limits).select("repo", "terms", F.explode("files").alias("path")).where("path is not null")
    if present is not None:
        each = each.join(present.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    pairs = cut(each.select(F.explode("terms").alias("term"), "path").groupBy("term", "path").agg(F.count(F.lit(1)).alias("n")))
    terms = pairs.groupBy("term").agg(F.sum("n").alias("term_n"), F.count(F.lit(1)).alias("__rows"))
    paths = pairs.groupBy("path").agg(F.sum("n").alias("path_n"), F.count(F.lit(1)).alias("__rows"))
    total = pairs.agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("__total"))
    sized = lambda margin, key: margin.select(key, "__rows").crossJoin(F.broadcast(total.select("__total")))
    joined = salted_join(pairs.where(F.col("n") >= support), terms.drop("__rows"), ["term"], sized(terms, "term"), F.col("__total"), ["path"])
    joined = salted_join(joined, paths.drop("__rows"), ["path"], sized(paths, "path"), F.col("__total"), ["term"]).crossJoin(F.broadcast(total.select("all_n")))
    pmi = F.log(F.col("n").cast("double") * F.col("all_n") / (F.col("term_n").cast("double") * F.col("path_n")))
    scored = joined.withColumn("pmi", pmi).where("pmi > 0").select("term", "path", "n", F.round(F.col("pmi") * F.log1p("n"), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "path"))  # cut to per_term rows before the shuffle
    return scored.withColumn("rank", rank).where(F.col("rank") <= per_term).drop("rank")


def prior_for(prior: DataFrame, words: list[str], most: int = 8) -> DataFrame:
    """(path, score) of the files the stems of the given words point to, best first."""
    asked = F.transform(F.array(*[F.lit(w) for w in words]), T.stem) if words else F.array().cast("array<string>")
    return prior.where(F.array_contains(asked, F.col("term"))).groupBy("path").agg(F.round(F.sum("score"), 4).alias("score")).orderBy(F.desc("score"), "path").limit(most)


EXPLAINING = ["fix", "feature", "refactor", "revert"]


def recent_commits(df: DataFrame, most: int = 8) -> DataFrame:
    """(repo, path, sha, rank) of the newest ``most`` commits of a file that are not docs, tests or chores.

    The newest are taken first and filtered after.
    """
    order = Window.partitionBy("repo", "path").orderBy(F.desc("authored_ts"), "sha")
    ranked = commit_files(df).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.where(F.col("change_class").isin(*EXPLAINING, "other")).select("repo", "path", "sha", "rank")


def introduced_by(df: DataFrame) -> DataFrame:
    """(repo, path, sha) of the oldest commit of each file; ties take the least sha."""
    return commit_files(df).groupBy("repo", "path").agg(F.min(F.struct("authored_ts", "sha")).alias("m")).select("repo", "path", F.col("m.sha").alias("sha"))


def commits_by_file(df: DataFrame) -> DataFrame:
    """(repo, path, n, newest): how often and when last each file changed."""
    return commit_files(df).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.max("authored_ts").alias("newest"))
