"""Processing only new or changed records, with the target as the state.

Output rows carry the key and version of the source record they came from. A run
anti-joins its source against them, processes what is left and publishes the next
target version with one atomic rename, so a run that dies leaves nothing behind
that a later run could skip or repeat.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.runtime import cut, pick, scratch_path, unclash


def normal_path(path: Column) -> Column:
    """``/`` as separator and no leading ``./`` (any number of them)."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./+)+", "")


def new_or_changed(source: DataFrame, state: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of ``source`` whose (keys, version) the state does not hold.

    Null versions are equal to each other and to nothing else; null keys likewise.
    Both sides are hashed on every key and the version, so one hot key component
    (a large repository) does not make a hot partition.
    """
    known = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(version).alias("__v"))
    match = source[version].eqNullSafe(known["__v"])
    for i, k in enumerate(keys):
        match = match & source[k].eqNullSafe(known[f"__k{i}"])
    return source.join(known, match, "left_anti")


def succeeded_runs(index_runs: DataFrame) -> DataFrame:
    """(repo, run_id, seq, next_run_id): succeeded runs in order of start within a repository.

    The row recorded last decides on a run (ties: the greater row). A run succeeded if
    that row says ``ok`` in any letter case, blanks around it ignored, and has an end.
    Runs without id or repository are ignored; equal starts are ordered by run id and a
    null start comes first.
    """
    runs = pick(index_runs, "run_id", "repo", "started_at", "finished_at", "status", "recorded_at")
    last = (
        runs.where(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.max(F.struct("recorded_at", "finished_at", "status", "started_at", "repo")).alias("r"))
        .select("run_id", "r.repo", "r.started_at", "r.finished_at", "r.status")
        .where((F.lower(F.trim("status")) == "ok") & F.col("finished_at").isNotNull() & F.col("repo").isNotNull())
    )
    order = Window.partitionBy("repo").orderBy(F.col("started_at").asc_nulls_first(), "run_id")
    return last.select(
        "repo",
        "run_id",
        F.row_number().over(order).alias("seq"),
        F.lead("run_id").over(order).alias("next_run_id"),
    )


def run_listing(files: DataFrame) -> DataFrame:
    """(run_id, path, hash): what a run saw last of each path, paths and hashes in one notation.

    Ties of ``listed_at`` take the greater hash; a null ``listed_at`` counts as earliest.
    Rows without run or path name no file and are left out; a null hash is a version of its own.
    """
    rows = pick(files, "run_id", "path", "hash", "listed_at").where(F.col("run_id").isNotNull() & F.col("path").isNotNull())
    return (
        rows.select("run_id", normal_path(F.col("path")).alias("path"), F.lower("hash").alias("hash"), "listed_at")
        .groupBy("run_id", "path")
        .agg(F.max(F.struct("listed_at", "hash")).alias("r"))
        .select("run_id", "path", F.col("r.hash").alias("hash"))
    )


def replay_changes(files: DataFrame, index_runs: DataFrame, root: str | None = None) -> DataFrame:
    """(run_id, path) new or changed in each succeeded run since the succeeded run before it.

    The runs are processed as they came: the k-th succeeded run of every repository is one
    ``sync`` of an ``IncrementalTarget`` that holds, for each path of a repository, the hash
    that was processed last. A path that a run no longer lists leaves the target, so it is new
    when it returns. Each sync publishes one version; the rows are what the versions added
    or changed. The first succeeded run of a repository fills the target and gives no rows.
    With ``root`` the target is kept there: a replay that died goes on behind the last round
    it published, without skipping or repeating one.
    """
    spark = files.sparkSession
    runs = cut(succeeded_runs(index_runs))
    rounds = runs.agg(F.max("seq")).first()[0] or 0
    listed = scratch_path(spark, "listing")
    listing = run_listing(files).join(runs.select("run_id", "repo", "seq"), "run_id")
    listing.write.partitionBy("seq").parquet(listed)
    schema = "run_id long, path string, hash string, repo string, seq int"
    target = IncrementalTarget(spark, root or scratch_path(spark, "target"), ["repo", "path"], "hash")
    for k in range((target.note() or 0) + 1, rounds + 1):
        source = spark.read.schema(schema).parquet(listed).where(F.col("seq") == k).select("repo", "path", "hash", "run_id", "seq")
        target.sync(source, complete=runs.where(F.col("seq") == k).select("repo"), note=k)
    changed = target.changes()
    if changed is None:
        return spark.createDataFrame([], "run_id long, path string")
    return changed.where("_change <> 'gone' and seq > 1").select("run_id", "path")


#: Columns a target adds; source columns of these names, and those that differ from others in letter case only, are renamed.
RESERVED = ("_change", "_version", "_kept", "_known", "_made", "_source_version", "_segment", "_newest", "_r")


class PublishConflict(RuntimeError):
    """Another run published the version this run was about to publish."""


class VersionLog:
    """Numbered JSON manifests under ``root``/manifests; the greatest number is the current state.

    A manifest is written under a fresh name and renamed to ``v<N>.json``; the rename is refused
    if N exists. This needs a file system whose rename is atomic and can refuse to overwrite
    (HDFS, a shared POSIX folder); object stores without a conditional put do not give it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def current(self) -> tuple[int, dict]:
        """(number, manifest) of the current version, (0, {}) before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        number = max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        return number, self.read(number) if number else {}

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, manifest: dict) -> None:
        staged = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(staged, self._path(f"{self.root}/manifests/v{number}.json"), options)
        except Exception as e:
            self._fs.delete(staged, False)
            raise PublishConflict(f"version {number} exists already") from e

    def delete(self, relative: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{relative}"), True)


class IncrementalTarget:
    """A versioned table of outputs that is its own processing state.

    ``root`` lies in a folder all executors share. Each sync writes one segment of Parquet
    files under a fresh name and then publishes a manifest of the live segments; until then
    readers and later runs see the version before. Segments that no manifest lists (from
    failed runs) are never read.

    ``version`` only says whether a record changed. Of several source rows of one key the one
    with the greatest ``order`` value counts (ties, and targets without ``order``: the
    greatest row by version and then by the other columns); a key that the target holds with
    a later ``order`` value than the source is not set back. ``transform`` gets the new or
    changed rows and must keep the key columns; source records for which it returns nothing
    are remembered by a row with ``_change`` 'none', so they are not tried again until they
    change. Null keys and versions are values like others.

    Segments are merged into one when there are more than ``MOST_SEGMENTS``, or when those
    after the first hold more rows than half of it, so a sync reads at most about twice the
    live rows and each row is rewritten a number of times that grows as the logarithm of all.
    """

    MOST_SEGMENTS = 8

    def __init__(self, spark: SparkSession, root: str, keys: list[str], version: str, order: str | None = None):
        self.spark, self.root, self.keys, self.version, self.order = spark, root.rstrip("/"), list(keys), version, order
        self.log = VersionLog(spark, root)

    def _same(self, left: DataFrame, right: DataFrame, names: list[str]) -> Column:
        match = F.lit(True)
        for k in names:
            match = match & left[k].eqNullSafe(right[k])
        return match

    def _segments(self, segments: list[list]) -> DataFrame | None:
        if not segments:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{path}").withColumn("_segment", F.lit(k)) for k, (path, _) in enumerate(segments)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows

    def _live(self, segments: list[list]) -> DataFrame | None:
        """The rows of the newest segment of each key that are not gone."""
        rows = self._segments(segments)
        if rows is None or len(segments) == 1:
            return None if rows is None else rows.where("_change <> 'gone'").drop("_segment")
        newest = rows.groupBy(*self.keys).agg(F.max("_segment").alias("_newest"))
        match = self._same(rows, newest, self.keys) & (rows["_segment"] == newest["_newest"])
        return rows.where("_change <> 'gone'").join(newest, match, "left_semi").drop("_segment")

    def _state(self, segments: list[list]) -> DataFrame | None:
        """(keys, version[, order]) of each live key: one aggregate over the key columns of the segments."""
        rows = self._segments(segments)
        if rows is None:
            return None
        own = [F.col("_source_version").alias(self.version), *([F.col(f"_source_{self.order}").alias(self.order)] if self.order else [])]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct("_segment", "_change", *own)).alias("_r"))
        return last.where("_r._change <> 'gone'").select(*self.keys, f"_r.{self.version}", *([f"_r.{self.order}"] if self.order else []))

    def note(self):
        """What the last sync left as its note."""
        return self.log.current()[1].get("note")

    def read(self) -> DataFrame | None:
        """Outputs of the current version, or None before the first."""
        rows = self._live(self.log.current()[1].get("segments", []))
        return None if rows is None else rows.where("_change <> 'none'").drop(*self._own())

    def _own(self) -> list[str]:
        return ["_change", "_source_version", *([f"_source_{self.order}"] if self.order else [])]

    def changes(self, since: int = 0) -> DataFrame | None:
        """The rows of all versions after ``since``, with ``_change``: new, changed, none (no output) or gone."""
        deltas = [self.log.read(n).get("delta") for n in range(since + 1, self.log.current()[0] + 1)]
        return self._segments([[d, 0] for d in deltas if d])

    def pending(self, source: DataFrame) -> DataFrame:
        """Rows of the source that the next ``sync`` would process."""
        return self._pending(source, self._state(self.log.current()[1].get("segments", []))).drop("_change")

    def _one(self, source: DataFrame) -> DataFrame:
        source = unclash(source, RESERVED)
        first = [*([self.order] if self.order else []), self.version]
        names = [c for c in source.columns if c not in (*self.keys, *first)]
        return source.groupBy(*self.keys).agg(F.max(F.struct(*first, *names)).alias("_r")).select(*self.keys, "_r.*")

    def _pending(self, source: DataFrame, state: DataFrame | None) -> DataFrame:
        one = self._one(source)
        if state is None:
            return one.withColumn("_change", F.lit("new"))
        own = [F.col(self.version).alias("_version"), F.lit("changed").alias("_change"), *([F.col(self.order).alias("_known")] if self.order else [])]
        known = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *own)
        match = F.lit(True)
        for i, k in enumerate(self.keys):
            match = match & one[k].eqNullSafe(known[f"_k{i}"])
        todo = one.join(known, match, "left").where(F.col("_change").isNull() | ~F.col(self.version).eqNullSafe(F.col("_version")))
        todo = todo.drop("_version", *[f"_k{i}" for i in range(len(self.keys))]).withColumn("_change", F.coalesce("_change", F.lit("new")))
        if self.order:
            todo = todo.where(F.col("_known").isNull() | (F.col(self.order) >= F.col("_known"))).drop("_known")
        return todo

    def sync(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None, complete: DataFrame | bool = False, note=None) -> int:
        """Process what is new or changed and publish it; returns the current version number.

        ``complete`` says that the source lists all there is: of everything (True), or of the
        values of the key columns that the frame given holds. Keys of that extent which the
        source lacks leave the target and count as new if they return. ``note`` is kept in the
        manifest.
        """
        number, manifest = self.log.current()
        segments = manifest.get("segments", [])
        state = self._state(segments)
        todo = self._pending(source, state)
        marks = [F.col(self.version).alias("_source_version"), *([F.col(self.order).alias(f"_source_{self.order}")] if self.order else [])]
        if transform is None:
            out = todo.select("*", *marks)
        else:
            todo = cut(todo)
            made = transform(todo.drop("_change"))
            marked = todo.select(*self.keys, "_change", *marks)
            body = [c for c in made.columns if c not in self.keys]
            made = made.withColumn("_made", F.lit(True))
            out = marked.join(made, self._same(marked, made, self.keys), "left").select(
                *[marked[k] for k in self.keys], *body, F.when(F.col("_made"), F.col("_change")).otherwise(F.lit("none")).alias("_change"), *[marked[c] for c in self._own()[1:]]
            )
        if state is not None and complete is not False:
            extent = state if complete is True else state.join(complete.dropDuplicates(), self._same(state, complete, complete.columns), "left_semi")
            one = unclash(source, RESERVED).select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(self.keys)])
            match = F.lit(True)
            for i, k in enumerate(self.keys):
                match = match & extent[k].eqNullSafe(one[f"_s{i}"])
            gone = extent.join(one, match, "left_anti")
            out = out.unionByName(gone.select(*self.keys, *marks, F.lit("gone").alias("_change")), allowMissingColumns=True)
        delta = f"segments/{uuid.uuid4().hex}"
        out.write.parquet(f"{self.root}/{delta}")
        rows = self.spark.read.parquet(f"{self.root}/{delta}").count()
        if not rows:
            self.log.delete(delta)
            return number
        live = [*segments, [delta, rows]]
        if len(live) > self.MOST_SEGMENTS or len(live) > 2 and sum(n for _, n in live[1:]) > live[0][1] / 2:
            live = [self._merged(live)]
        self.log.publish(number + 1, {"segments": live, "delta": delta, "note": note})
        return number + 1

    def _merged(self, segments: list[list]) -> list:
        path = f"segments/{uuid.uuid4().hex}"
        self._live(segments).write.parquet(f"{self.root}/{path}")
        return [path, self.spark.read.parquet(f"{self.root}/{path}").count()]

    def compact(self) -> int:
        """Rewrite the live rows as one segment under a new version."""
        number, manifest = self.log.current()
        segments = manifest.get("segments", [])
        if len(segments) < 2:
            return number
        self.log.publish(number + 1, {"segments": [self._merged(segments)], "note": manifest.get("note")})
        return number + 1
