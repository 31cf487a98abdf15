"""Stages of the graph on disk, and the lock that keeps two indexers apart."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.incremental import VersionLog

SCHEMA_VERSION = 2


class StageStore:
    """Stages of the graph, each with the fingerprint of the input it was made from.

    A stage is written under a fresh name; what is read changes when ``publish`` renames one
    manifest of all stages into place, so a reader never meets half of an update and a failed
    one leaves the stages before. Folders that a version replaced go when the next is published.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = VersionLog(spark, root)
        self._new: dict[str, dict] = {}
        self._held = False

    def _stages(self) -> dict[str, dict]:
        manifest = self.log.current()[1]
        if manifest and manifest["schema"] != SCHEMA_VERSION:
            raise ValueError(f"the stages have schema {manifest['schema']}, not {SCHEMA_VERSION}")
        return manifest.get("stages", {})

    def fingerprint(self, stage: str) -> str | None:
        return self._stages().get(stage, {}).get("input")

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{(self._stages() | self._new)[stage]['path']}")

    def hold(self) -> None:
        """Publish nothing until ``publish`` is called."""
        self._held, self._new = True, {}

    def write(self, stage: str, rows: DataFrame, input_fingerprint: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{stage}/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{path}")
        self._new[stage] = {"path": path, "input": input_fingerprint}
        if not self._held:
            self.publish()
        return self.spark.read.parquet(f"{self.root}/{path}")

    def publish(self) -> None:
        number, manifest = self.log.current()
        stages = manifest.get("stages", {})
        replaced = [stages[name]["path"] for name in self._new if name in stages]
        self.log.publish(number + 1, {"schema": SCHEMA_VERSION, "stages": stages | self._new, "replaced": replaced})
        for path in manifest.get("replaced", []):
            self.log.delete(path)
        self._held, self._new = False, {}

    def cached(self, stage: str, input_fingerprint: str, make) -> tuple[DataFrame, bool]:
        """The stage as stored if its input is the same, else made anew; and whether it was reused."""
        if self.fingerprint(stage) == input_fingerprint:
            return self.read(stage), True
        return self.write(stage, make(), input_fingerprint), False


def frame_fingerprint(rows: DataFrame) -> str:
    """A digest of the rows of a frame, whatever their order; repeated rows count."""
    h = F.xxhash64(*rows.columns)
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_000_007)).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.x}:{r.s}"


@contextlib.contextmanager
def index_lock(path: str):
    """Hold a lock file with this process's id; one left by a process that is gone is taken over."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        with open(path, encoding="ascii") as f:
            pid = int(f.read().strip() or 0)
        if pid and os.path.exists(f"/proc/{pid}"):
            raise RuntimeError(f"process {pid} is indexing") from None
        os.unlink(path)
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        os.unlink(path)
