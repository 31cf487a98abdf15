"""Evaluation of retrieval: tasks from history, scores of answers, summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import history


def upper_median(value: str) -> Column:
    """The element at half the count of the sorted values, the upper one for even counts; null for none."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)").cast("long")  # counts of values, not the values


def score_outcomes(offers: DataFrame, truth: DataFrame) -> DataFrame:
    """(task, condition, recall, precision, first_hit_rank, tokens_to_first_hit, tokens_total, files, wrong_files).

    offers: task, condition, path, place (from 1), tokens. truth: task, path. A task of a
    condition without offers has no row here; ``summarise`` counts it through ``tasks``.
    """
    wanted = truth.select("task", "path").distinct()
    need = wanted.groupBy("task").agg(F.count(F.lit(1)).alias("need"))
    running = Window.partitionBy("task", "condition").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    marked = offers.join(wanted.withColumn("hit", F.lit(True)), ["task", "path"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("cost", F.sum("tokens").over(running))
    grouped = marked.groupBy("task", "condition").agg(
        F.count_distinct(F.when(F.col("hit"), F.col("path"))).alias("hits"),
        F.min(F.when(F.col("hit"), F.col("place"))).alias("first_hit_rank"),
        F.min(F.when(F.col("hit"), F.col("cost"))).alias("tokens_to_first_hit"),
        F.sum("tokens").alias("tokens_total"),
        F.count(F.lit(1)).alias("files"),
        F.count_if(~F.col("hit")).alias("wrong_files"),
    )
    return grouped.join(need, "task").select(
        "task", "condition", F.round(F.col("hits") / F.col("need"), 4).alias("recall"), F.round(F.col("hits") / F.col("files"), 4).alias("precision"),
        "first_hit_rank", "tokens_to_first_hit", "tokens_total", "files", "wrong_files",
    )


def summarise(outcomes: DataFrame) -> DataFrame:
    """One row for each condition: tasks, hits, hit rate, mean recall and precision, MRR and upper medians."""
    return outcomes.groupBy("condition").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count("first_hit_rank").alias("tasks_with_a_hit"),
        F.round(F.count("first_hit_rank") / F.count(F.lit(1)), 4).alias("hit_rate"),
        F.round(F.avg("recall"), 4).alias("mean_recall"),
        F.round(F.avg("precision"), 4).alias("mean_precision"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0))), 4).alias("mrr"),
        upper_median("tokens_to_first_hit").alias("median_tokens_to_first_hit"),
        upper_median("tokens_total").alias("median_tokens_total"),
        upper_median("files").alias("median_files"),
    )


def expected_tokens(outcomes: DataFrame, penalty: int) -> DataFrame:
    """(condition, expected_tokens): tokens to the first hit, ``penalty`` where there is none."""
    return outcomes.groupBy("condition").agg(F.round(F.avg(F.coalesce("tokens_to_first_hit", F.lit(penalty))), 4).alias("expected_tokens"))


def paired(outcomes: DataFrame, first: str, second: str) -> DataFrame:
    """Both conditions on their common tasks: both hit, only one, neither, and the mean saving where both hit."""
    side = lambda name, c: outcomes.where(F.col("condition") == c).select("task", F.col("tokens_to_first_hit").alias(name))
    both = side("a", first).join(side("b", second), "task")
    hit_a, hit_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(hit_a & hit_b).alias("both_hit"), F.count_if(hit_a & ~hit_b).alias("only_first"),
        F.count_if(~hit_a & hit_b).alias("only_second"), F.count_if(~hit_a & ~hit_b).alias("neither"), F.round(F.avg(F.col("a") - F.col("b")), 4).alias("mean_saving"),
    )


def losses(outcomes: DataFrame, baseline: str, ours: str) -> DataFrame:
    """(task, loss) where the baseline hit and ours did not, or hit for fewer tokens."""
    side = lambda name, c: outcomes.where(F.col("condition") == c).select("task", F.col("tokens_to_first_hit").alias(name))
    both = side("base", baseline).join(side("own", ours), "task").where("base is not null")
    loss = F.when(F.col("own").isNull(), "missed").when(F.col("base") < F.col("own"), "dearer")
    return both.withColumn("loss", loss).where("loss is not null").select("task", "loss", "base", "own")


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share, rounded to four digits; 0 for no tasks."""
    n, p = F.greatest(total, F.lit(1)).cast("double"), F.coalesce(F.try_divide(hits, total), F.lit(0.0))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = total > 0
    return F.when(some, F.round(middle - half, 4)).otherwise(0.0), F.when(some, F.round(middle + half, 4)).otherwise(0.0)


def agent_summary(outcomes: DataFrame) -> DataFrame:
    """(condition, tasks, hits, hit_rate, low, high, mean_recall, errors): answers that ended in an error are left out of the shares."""
    fine = F.col("error").isNull()
    g = outcomes.groupBy("condition").agg(F.count_if(fine).alias("tasks"), F.count_if(fine & F.col("hit")).alias("hits"), F.round(F.avg(F.when(fine, F.col("recall"))), 4).alias("mean_recall"), F.count_if(~fine).alias("errors"))
    low, high = wilson(F.col("hits"), F.col("tasks"))
    return g.withColumn("hit_rate", F.round(F.try_divide("hits", "tasks"), 4)).withColumn("low", low).withColumn("high", high)


def headroom(summary: DataFrame, arm: str, floor: str, oracle: str) -> DataFrame:
    """The share of the way from the floor's hit rate to the oracle's that an arm goes; null where there is none."""
    wide = summary.groupBy().pivot("condition", [arm, floor, oracle]).agg(F.first("hit_rate"))
    return wide.select(F.round(F.try_divide(F.col(f"`{arm}`") - F.col(f"`{floor}`"), F.col(f"`{oracle}`") - F.col(f"`{floor}`")), 4).alias("headroom"))


def rank_audit(ranks: DataFrame) -> DataFrame:
    """(verdict, n): where a wanted file stood. ranks: task, place (null: not scored), offered, connected."""
    verdict = (
        F.when(F.col("place").isNull() & F.col("connected"), "unscored_connected").when(F.col("place").isNull(), "unscored_unconnected").when(~F.col("offered"), "cut")
        .when(F.col("place") == 1, "first").when(F.col("place") <= 3, "top3").otherwise("late")
    )
    return ranks.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# Words of subjects that describe mechanical changes.
MECHANICAL = ["bump", "version", "translation", "typo", "lint", "format", "changelog", "merge", "revert", "pre-commit", "ci:", "chore", "whitespace", "rename"]


def tasks_from_history(commits: DataFrame, present: DataFrame, least_words: int = 5, most_files: int = 6) -> DataFrame:
    """(task, repo, prompt, path): fixes and features whose subject says enough and that changed one to six present code files, no tests.

    present: repo, path of the files that existed.
    """
    rows = history.commits(commits).where(F.col("change_class").isin("fix", "feature") & F.col("subject").isNotNull())
    rows = rows.withColumn("prompt", T.clean_subject("subject"))
    plain = ~F.lower("subject").rlike("|".join(MECHANICAL))
    rows = rows.where((F.size(F.split("prompt", " ")) >= least_words) & plain)
    code = F.filter("files", lambda p: T.file_language(p).isin(T.lex.CODE_LANGUAGES))
    rows = rows.withColumn("code", code).where(F.size("code").between(1, most_files) & ~F.exists("code", T.is_test_path))
    return rows.select(F.col("sha").alias("task"), "repo", "prompt", F.explode("code").alias("path")).join(present.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("task", "repo", "prompt", "path")


def arm_table(results: DataFrame) -> DataFrame:
    """Hits, MRR and full recall of conditions by repository, with a row for all. results: repo, condition, first_hit_rank, recall."""
    return results.rollup("condition", "repo").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("tasks"), F.round(F.avg(F.col("first_hit_rank").isNotNull().cast("int")), 4).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg((F.col("recall") >= 1).cast("int")), 4).alias("full_recall"),
    ).where("level < 3").select("condition", F.when(F.col("level") == 1, "ALL").otherwise(F.col("repo")).alias("repo"), "tasks", "hit_rate", "mrr", "full_recall")


def common_grades(grades: DataFrame, first: str, second: str) -> DataFrame:
    """(outcome, n) of the instances both arms were graded on: both, only_first, only_second or neither resolved."""
    a = grades.where(F.col("arm") == first).select("instance", F.col("resolved").alias("ra"))
    b = grades.where(F.col("arm") == second).select("instance", F.col("resolved").alias("rb"))
    outcome = F.when(F.col("ra") & F.col("rb"), "both").when(F.col("ra"), "only_first").when(F.col("rb"), "only_second").otherwise("neither")
    return a.join(b, "instance").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def fit_weights(start: dict[str, float], grid: dict[str, list[float]], value, sweeps: int = 2) -> tuple[dict[str, float], float]:
    """Coordinate descent: each weight in turn takes the grid value of greatest ``value(weights)``; ties keep the present one."""
    best, best_value = dict(start), value(start)
    for _ in range(sweeps):
        for name, options in grid.items():
            for option in options:
                tried = best | {name: option}
                if (v := value(tried)) > best_value:
                    best, best_value = tried, v
    return best, best_value


def offered_order(reading: DataFrame, files: DataFrame) -> DataFrame:
    """(task, path, place, tokens): files of the reading plan in its order with their tokens, then the other code files for nothing.

    reading: task, path, ord, tokens. files: task, path, rank.
    """
    read = reading.groupBy("task", "path").agg(F.min("ord").alias("o"), F.sum("tokens").alias("tokens")).withColumn("group", F.lit(0))
    code = files.where(T.file_language("path").isin(T.lex.CODE_LANGUAGES)).join(read.select("task", "path"), ["task", "path"], "left_anti")
    rest = code.select("task", "path", F.col("rank").alias("o"), F.lit(0).cast("long").alias("tokens"), F.lit(1).alias("group"))
    place = F.row_number().over(Window.partitionBy("task").orderBy("group", "o", "path"))
    return read.unionByName(rest).select("task", "path", place.alias("place"), "tokens")
