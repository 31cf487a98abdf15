"""Session helpers: table access, column picking, lineage cuts and skew-safe joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each context, wherever they and the driver were started."""
    context = spark.sparkContext
    if getattr(context, "_quarrylens_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarrylens-"), "quarrylens.zip")  # Spark serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    context._quarrylens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Select columns by exact name, renaming ``out=source`` pairs.

    Works by position, so a frame that also carries columns whose names differ
    only in letter case (or repeat, or hold dots) is never ambiguous. The first
    column with the exact name wins; without one, the first that matches
    ignoring case.
    """
    wanted = {n: n for n in names} | renamed
    columns = df.columns
    folded = [c.lower() for c in columns]
    position = {}
    for out, source in wanted.items():
        if source in columns:
            position[out] = columns.index(source)
        elif source.lower() in folded:
            position[out] = folded.index(source.lower())
        else:
            raise ValueError(f"column {source!r} not found in {columns}")
    flat = df.toDF(*[f"__c{i}" for i in range(len(columns))])
    return flat.select(*[F.col(f"__c{i}").alias(out) for out, i in position.items()])


def unclash(df: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """The same columns under names that also differ without letter case: later ones that clash get ``__2``, ``__3``."""
    seen = {r.lower() for r in reserved}
    names = []
    for c in df.columns:
        name, k = c, 1
        while name.lower() in seen:
            k += 1
            name = f"{c}__{k}"
        seen.add(name.lower())
        names.append(name)
    return df if names == df.columns else df.toDF(*names)


def parallel(scan: DataFrame) -> DataFrame:
    """A scan whose rows cost much CPU, spread over all cores where its files make fewer partitions than that."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and all is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and drop the lineage (survives executor loss)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000
HOT_SALTS = 32


def hot_salts(spark: SparkSession) -> int:
    """Tasks the rows of a hot key are spread over: as many as a shuffle has, which is set by the size of the data."""
    return max(HOT_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    sizes: DataFrame,
    total: Column,
    salt_on: list[str],
    salts: int | None = None,
) -> DataFrame:
    """Inner join on ``keys`` where ``right`` has one row per key and ``left`` may be skewed.

    ``sizes`` (keys, ``__rows``) gives the rows ``left`` holds of each key. Keys above
    ``total / HOT_SHARE`` number at most HOT_SHARE whatever the data, which bounds the
    broadcast; their left rows are spread over ``salts`` tasks by a hash of ``salt_on``
    and their single right row is repeated for each salt. No row is dropped.
    """
    salts = salts or hot_salts(left.sparkSession)
    hot = sizes.where(F.col("__rows") > total / F.lit(HOT_SHARE)).select(*keys, F.lit(True).alias("__hot"))
    tagged = left.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    spread = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return tagged.drop("__hot").join(spread, [*keys, "__salt"]).drop("__salt")
