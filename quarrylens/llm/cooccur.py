"""Items that appear together: an incremental table of pair counts.

A basket that is added, removed or changed emits signed deltas: one for every pair of
its items, one for every item and one for its group. Deltas are merged into persistent
counts that are bucketed by a hash of their key, and the scores of the pairs that a
delta can move are computed again from the merged counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.incremental import VersionLog
from quarrylens.runtime import cut, pick, salted_join, scratch_path

COUNTS = "grp string, a string, b string, n long"
SCORE_FIELDS = [("shared", "long"), ("count_a", "long"), ("count_b", "long"), ("total", "long"), ("lift", "double"), ("npmi", "double")]
SCORES = "grp string, a string, b string, " + ", ".join(f"{c} {t}" for c, t in SCORE_FIELDS)
#: Baskets with more items than this are spread over tasks before their pairs are listed.
WIDE = 64


def _joined(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(items))))


def delivered_baskets(commits: DataFrame, least: int = 1, steps: int = 1) -> tuple[DataFrame, DataFrame]:
    """(baskets, names): the files of each commit that reached us in each of ``steps`` spans of time.

    Baskets are (basket, grp, batch, items); names (grp, item, code) gives the short codes that
    stand for the files in ``items``, which keeps the rows of their pairs small. Commits are one
    basket by sha without letter case; those without a time come with the first batch. A commit
    without files is an empty basket: it counts in its repository. Items that fewer than
    ``least`` baskets of their group hold are left out. Rows without sha or repository are left
    out; a sha seen in two repositories is a basket in each.
    """
    rows = pick(commits, "sha", "repo", "files", "ingested_at").where("sha is not null and repo is not null")
    at = F.col("ingested_at").cast("timestamp").cast("double")
    span = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    batch = F.lit(0)
    if steps > 1 and span.low is not None and span.high > span.low:
        batch = F.coalesce(F.least(F.floor((at - span.low) / ((span.high - span.low) / steps)), F.lit(steps - 1)), F.lit(0))
    rows = rows.select(F.lower("sha").alias("basket"), F.col("repo").alias("grp"), batch.cast("int").alias("batch"), "files")
    opened = rows.select("basket", "grp", "batch", F.explode(F.array_distinct("files")).alias("item")).where("item is not null")
    counted = opened.groupBy("grp", "item").agg(F.count_distinct("basket").alias("n"), F.count(F.lit(1)).alias("__rows"))
    names = cut(counted.where(F.col("n") >= least).select("grp", "item", "__rows", F.lower(F.conv(F.monotonically_increasing_id().cast("string"), 10, 36)).alias("code")))
    total = names.agg(F.sum("__rows").alias("__total"))
    coded = salted_join(opened, names.select("grp", "item", "code"), ["grp", "item"], names.select("grp", "item", "__rows").crossJoin(F.broadcast(total)), F.col("__total"), ["basket"])
    heads = rows.select("basket", "grp", "batch", F.lit(None).cast("string").alias("code"))
    baskets = coded.select(*heads.columns).unionByName(heads).groupBy("basket", "grp", "batch").agg(F.array_sort(F.collect_set("code")).alias("items"))
    return baskets, names.select("grp", "item", "code")


def deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(grp, a, b, n): signed changes of the counts from one state of baskets to another.

    Pairs have a < b by code points; item counts have b null, group counts a and b null.
    Only baskets that differ are listed: equal ones cancel before any pair is made.
    """
    signed = after.select("basket", "grp", "items", F.lit(1).alias("sign"))
    if before is not None:
        signed = signed.unionByName(before.select("basket", "grp", "items", F.lit(-1).alias("sign")))
        signed = signed.groupBy("basket", "grp", "items").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    singles = signed.select(
        "grp", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("items"))).alias("a"), F.lit(None).cast("string").alias("b"), F.col("sign").cast("long").alias("n")
    )
    heads = signed.where(F.size("items") > 1).select("basket", "grp", "items", "sign", F.posexplode("items").alias("at", "a"))
    heads = heads.select("basket", "grp", "sign", "a", F.expr("slice(items, at + 2, size(items))").alias("rest")).where(F.size("rest") > 0)
    wide = heads.where(F.size("rest") > WIDE).repartition("basket", "a")
    pairs = (
        heads.where(F.size("rest") <= WIDE)
        .unionByName(wide)
        .select("grp", "a", F.explode("rest").alias("b"), F.col("sign").cast("long").alias("n"))
    )
    return singles.unionByName(pairs).groupBy("grp", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def merge(counts: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Counts after the changes; keys that reach zero vanish."""
    if counts is None:
        return changes.where("n <> 0")
    return counts.unionByName(changes).groupBy("grp", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def affected(counts: DataFrame, changes: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of ``least`` baskets whose score a change can move: the pair, one of its items or its group changed."""
    pairs = counts.where("b is not null").where(F.col("n") >= least)
    groups = changes.where("a is null").select("grp").distinct()
    items = changes.where("a is not null and b is null").select("grp", F.col("a").alias("item"))
    by_group = pairs.join(groups, "grp", "left_semi")
    rest = pairs.join(groups, "grp", "left_anti")
    as_a, as_b = items.withColumnRenamed("item", "a"), items.withColumnRenamed("item", "b")
    left = rest.join(as_a, ["grp", "a"], "left_semi")
    right = rest.join(as_a, ["grp", "a"], "left_anti").join(as_b, ["grp", "b"], "left_semi")
    return by_group.unionByName(left).unionByName(right).select("grp", "a", "b", "n")


def associate(counts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Scores of pairs: shared, count_a, count_b, total, lift and npmi (1.0 where every basket holds both).

    ``pairs`` restricts the result (see ``affected``); by default all pairs are scored.
    """
    pairs = (counts if pairs is None else pairs).where("b is not null").select("grp", "a", "b", F.col("n").alias("shared"))
    items = counts.where("a is not null and b is null")
    groups = counts.where("a is null").select("grp", F.col("n").alias("total"))
    counts_a = items.select("grp", "a", F.col("n").alias("count_a"))
    counts_b = items.select("grp", F.col("a").alias("b"), F.col("n").alias("count_b"))
    number = pairs.agg(F.count(F.lit(1)).alias("__total"))

    def sized(side: str) -> DataFrame:
        return pairs.groupBy("grp", side).agg(F.count(F.lit(1)).alias("__rows")).crossJoin(F.broadcast(number))

    scored = salted_join(pairs, counts_a, ["grp", "a"], sized("a"), F.col("__total"), ["b"])
    scored = salted_join(scored, counts_b, ["grp", "b"], sized("b"), F.col("__total"), ["a"])
    scored = salted_join(scored, groups, ["grp"], pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("__rows")).crossJoin(F.broadcast(number)), F.col("__total"), ["a", "b"])
    lift = F.col("shared") * F.col("total") / (F.col("count_a") * F.col("count_b"))
    share = F.col("shared") / F.col("total")
    return scored.select(
        "grp", "a", "b", "shared", "count_a", "count_b", "total",
        lift.alias("lift"),
        F.when(share >= 1, F.lit(1.0)).otherwise(F.log(lift) / -F.log(share)).alias("npmi"),
    )


class PairTable:
    """Persistent counts and scores under ``root``, bucketed by a hash of their key.

    An update reads only the buckets its deltas fall into, writes them anew under a fresh
    name, scores the affected pairs again and then publishes one manifest that maps every
    bucket to its folder and lists the score segments, so a failed update leaves the table
    as it was. Scores are kept of pairs that ``least`` baskets share; the newest segment that
    holds a pair has its score, and a pair that fell under ``least`` is marked as gone.
    """

    #: Score segments that are read together before they are merged into one.
    MOST_SEGMENTS = 8

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, least: int = 1):
        self.spark, self.root, self.buckets, self.least = spark, root.rstrip("/"), buckets, least
        self.log = VersionLog(spark, root)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("grp", "a", "b"), F.lit(self.buckets)).cast("int"))

    def _live(self, where: dict[str, str], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{v}/bucket={k}" for k, v in where.items() if only is None or int(k) in only]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def counts(self) -> DataFrame:
        """(grp, a, b, n): item counts have b null, basket counts a and b null."""
        return self._live(self.log.current()[1].get("buckets", {}))

    def _scores(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SCORES)
        rows = None
        for k, path in enumerate(segments):
            part = self.spark.read.schema(SCORES).parquet(f"{self.root}/{path}").withColumn("__at", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        if len(segments) > 1:
            own = ["__at", *[c for c in rows.columns if c not in ("grp", "a", "b", "__at")]]
            rows = rows.groupBy("grp", "a", "b").agg(F.max(F.struct(*own)).alias("r")).select("grp", "a", "b", "r.*")
        return rows.where("shared is not null").drop("__at")

    def scores(self) -> DataFrame:
        """The score of every pair that ``least`` baskets share."""
        return self._scores(self.log.current()[1].get("scores", []))

    def update(self, before: DataFrame | None, after: DataFrame) -> DataFrame:
        """Merge the change of baskets; returns the affected pairs with new scores.

        Only baskets that differ count, so both frames may hold the changed baskets alone.
        A change of nothing publishes nothing.
        """
        number, state = self.log.current()
        where, segments = state.get("buckets", {}), state.get("scores", [])
        folder = uuid.uuid4().hex
        staged = f"{self.root}/changes/{folder}"
        self._bucketed(deltas(before, after)).write.parquet(staged)
        changes = self.spark.read.schema(f"{COUNTS}, bucket int").parquet(staged)
        touched = {r.bucket for r in changes.select("bucket").distinct().collect()}  # at most self.buckets rows
        if not touched:
            return self.spark.createDataFrame([], SCORES)
        both = self._bucketed(self._live(where, touched)).unionByName(changes).repartition(self.buckets, "bucket")
        merged = both.groupBy("bucket", "grp", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        merged.write.partitionBy("bucket").parquet(f"{self.root}/counts/{folder}")
        written = self.spark.read.schema(f"{COUNTS}, bucket int").parquet(f"{self.root}/counts/{folder}").select("bucket").distinct().collect()  # at most self.buckets rows
        live = {k: v for k, v in where.items() if int(k) not in touched} | {str(r.bucket): f"counts/{folder}" for r in written}
        counts = self._live(live)
        moved = associate(counts, affected(counts, changes, self.least))
        moved.write.parquet(f"{self.root}/scores/{folder}")
        rescored = self.spark.read.schema(SCORES).parquet(f"{self.root}/scores/{folder}")
        new = [*segments, f"scores/{folder}"]
        less = changes.where("b is not null and n < 0")
        if segments and not less.isEmpty():
            fallen = less.select("grp", "a", "b").join(rescored, ["grp", "a", "b"], "left_anti")
            gone = self._scores(segments).join(fallen, ["grp", "a", "b"], "left_semi").select("grp", "a", "b", *[F.lit(None).cast(t).alias(c) for c, t in SCORE_FIELDS])
            gone.write.mode("append").parquet(f"{self.root}/scores/{folder}")
            if len(new) > self.MOST_SEGMENTS:
                self._scores(new).write.parquet(f"{self.root}/scores/{folder}-merged")
                new = [f"scores/{folder}-merged"]
        self.log.publish(number + 1, {"buckets": live, "scores": new})
        return rescored.where("shared is not null")


def found(commits: DataFrame, shared: int = 5, times: int = 3, steps: int = 2) -> DataFrame:
    """File pairs of a repository changed together in ``shared`` commits at least, ``times`` as often as chance.

    The deliveries reach a ``PairTable`` in ``steps`` batches by their time (those without a time
    with the first), each as the baskets it changed. Files of fewer than ``shared`` commits are left
    out of the baskets: no pair of them can be a case, and no other count depends on them.
    """
    spark = commits.sparkSession
    table = PairTable(spark, scratch_path(spark, "pairs"), buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), least=shared)
    baskets, names = delivered_baskets(commits, shared, steps)
    delivered = cut(baskets)
    for k in range(steps):
        both = delivered.where(F.col("batch") <= k).groupBy("basket", "grp").agg(
            F.max("batch").alias("last"), F.min("batch").alias("first"), _joined(F.col("items")).alias("items"), _joined(F.when(F.col("batch") < k, F.col("items"))).alias("known")
        )
        changed = both.where(F.col("last") == k)
        before = changed.where(F.col("first") < k).select("basket", "grp", F.col("known").alias("items"))
        table.update(before if k else None, changed.select("basket", "grp", "items"))
    hits = table.scores().where((F.col("shared") >= shared) & (F.col("shared") * F.col("total") >= times * F.col("count_a") * F.col("count_b")))
    for side in ("a", "b"):
        hits = hits.join(names.select("grp", F.col("item").alias(f"path_{side}"), F.col("code").alias(side)), ["grp", side])
    return hits.select(F.col("grp").alias("repo"), F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"))
