"""Repositories as file tables: walking, reading, skipping what is not indexed."""

from __future__ import annotations

import fnmatch
import os
import re

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import lexicon as lex
from quarrylens.functions import text as T
from quarrylens.sources import documents


def ignore_rules(root: str) -> list[tuple[str, bool]]:
    """(regular expression over relative paths, negated) of the ignore files of a tree, those of outer folders first."""
    rules = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in lex.EXCLUDED_FOLDERS)
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        for name in (".gitignore", ".quarrylensignore"):
            if name in names:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    for line in map(str.strip, f):
                        if line and not line.startswith("#"):
                            rules.append((rule_pattern(line.lstrip("!"), "" if base == "." else base), line.startswith("!")))
    return rules


def rule_pattern(pattern: str, base: str = "") -> str:
    """A regular expression over relative paths for one ignore pattern of the folder ``base``."""
    body = pattern.strip("/")
    anchored = "/" in body or pattern.startswith("/")
    core = fnmatch.translate(body).removesuffix(r"\Z").removesuffix(r"\z").replace("(?s:", "(?:").replace(".*", "[^/]*" if "**" not in body else ".*")
    start = "^" + re.escape(base + "/") if base else "^"
    return start + ("" if anchored else "(?:.*/)?") + core + (r"/" if pattern.endswith("/") else r"(?:/|$)")


def skip_reason(path: Column, size: Column, content: Column, rules: list[tuple[str, bool]]) -> Column:
    """Why a file is not indexed: folder, generated, ignored, large or binary; null if it is.

    Documents in packed formats are binary by nature and are not tested for it.
    """
    folders = F.split(path, "/")
    excluded = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*[F.lit(d) for d in lex.EXCLUDED_FOLDERS]))
    generated = F.lit(False)
    for s in lex.EXCLUDED_SUFFIXES:
        generated = generated | path.endswith(s)
    ignored = F.lit(False)
    for pattern, negated in rules:
        hit = path.rlike(pattern)
        ignored = ignored & ~hit if negated else ignored | hit
    packed = T.file_language(path).isin("docx", "doc", "odt", "xlsx", "pptx", "pdf")
    binary = ~packed & (~F.is_valid_utf8(content) | F.contains(content, F.lit(bytearray(b"\x00"))))
    return F.when(excluded, "folder").when(generated, "generated").when(ignored, "ignored").when(size > lex.MAX_FILE_BYTES, "large").when(binary, "binary")


def _is_local(root: str) -> bool:
    return os.path.isdir(root)


def listing(spark: SparkSession, root: str, prune: bool = False) -> DataFrame:
    """(path, bytes, mtime) of the files below a root, hidden ones aside, without reading them.

    A folder of this machine is listed by its directory entries; ``prune`` leaves out the folders
    that are never indexed. Any other place is listed by Spark.
    """
    if not _is_local(root):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        base = "^" + re.escape(root.rstrip("/")) + "/"
        return raw.select(F.regexp_replace("path", base, "").alias("path"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("mtime"))
    paths, sizes, times = [], [], []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if not d.startswith(".") and not (prune and d in lex.EXCLUDED_FOLDERS))
        for name in names:
            full = os.path.join(folder, name)
            if not name.startswith(".") and os.path.isfile(full):
                stat = os.stat(full)
                paths.append(os.path.relpath(full, root).replace(os.sep, "/"))
                sizes.append(stat.st_size)
                times.append(stat.st_mtime_ns // 1000)
    table = pa.table({"path": pa.array(paths, pa.string()), "bytes": pa.array(sizes, pa.int64()), "mtime": pa.array(times, pa.int64())})
    return spark.createDataFrame(table)


def contents(rows: DataFrame, root: str) -> DataFrame:
    """Adds ``content`` to rows of a listing, and ``told``, the text of packed documents and rich text, null for broken ones.

    The files are read where the rows lie. Files that are gone by now are left out.
    """
    spark = rows.sparkSession
    if not _is_local(root):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rows = rows.join(raw.select(F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "").alias("path"), "content"), "path")
    base = os.path.abspath(root) if _is_local(root) else None
    kinds = {e: k for k in PACKED for e in lex.EXTENSIONS[k].split()}

    def told(path: str, content: bytes | None) -> str | None:
        kind = kinds.get(path.rsplit("/", 1)[-1].rpartition(".")[2])
        if kind is None or content is None:
            return None
        return documents.rtf_to_text(content.decode("cp1252", "replace")) if kind == "rtf" else documents.packed_to_markdown(content, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # few files at once, as they may be large
                part = batch.slice(at, 256)
                names, found = part.column("path").to_pylist(), []
                for path in names if base else []:
                    try:
                        with open(os.path.join(base, path), "rb") as f:
                            found.append(f.read())
                    except OSError:
                        found.append(None)
                found = found if base else part.column("content").to_pylist()
                texts = pa.array([told(p, c) for p, c in zip(names, found)], pa.string())
                own = [part.column(c) for c in ("path", "bytes", "mtime")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.binary()), texts], ["path", "bytes", "mtime", "content", "told"])

    spread = rows.repartition(spark.sparkContext.defaultParallelism) if base else rows
    return spread.mapInArrow(run, "path string, bytes long, mtime long, content binary, told string").where("content is not null")


def stamps(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, mtime) of the files that may be indexed, without reading them."""
    rows = listing(spark, root, prune=True)
    skipped = skip_reason(F.col("path"), F.col("bytes"), F.lit(bytearray()), ignore_rules(root))
    return rows.where(skipped.isNull())


#: Formats that a kernel reads.
PACKED = ["docx", "odt", "xlsx", "pptx", "rtf"]


def _with_text(rows: DataFrame, root: str) -> DataFrame:
    """The columns of ``walk`` for rows with contents. Packed documents and rich text are given as the text they hold."""
    rows = rows.withColumn("skipped", skip_reason(F.col("path"), F.col("bytes"), F.col("content"), ignore_rules(root))).withColumn("lang", T.file_language("path"))
    text = F.when(F.col("skipped").isNull(), F.when(F.col("lang").isin(*PACKED), F.col("told")).when(F.is_valid_utf8("content"), F.decode("content", "utf-8")))
    lines = F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n"))
    return rows.withColumn("text", text).select("path", "lang", F.sha2("content", 256).alias("hash"), "bytes", F.when(F.length("text") > 0, lines).otherwise(0).alias("lines"), "mtime", "text", "content", "skipped")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, hash, bytes, lines, mtime, text, content, skipped) of every file below a root."""
    return _with_text(contents(listing(spark, root), root), root)


def read_listed(rows: DataFrame, root: str) -> DataFrame:
    """The rows ``walk`` gives for some rows of a listing, reading only these."""
    return _with_text(contents(rows.select("path", "bytes", "mtime"), root), root)


def skip_summary(files: DataFrame) -> DataFrame:
    return files.where("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "reason")


def with_known_hash(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``unchanged``: whether mtime (not 0) and size are those a stored record has, whose hash is then kept."""
    old = known.select("path", F.col("hash").alias("old_hash"), F.col("bytes").alias("old_bytes"), F.col("mtime").alias("old_mtime"))
    same = (F.col("mtime") != 0) & (F.col("mtime") == F.col("old_mtime")) & (F.col("bytes") == F.col("old_bytes"))
    joined = found.join(old, "path", "left").withColumn("unchanged", F.coalesce(same, F.lit(False)))
    return joined.withColumn("hash", F.when(F.col("unchanged"), F.col("old_hash")).otherwise(F.col("hash"))).drop("old_hash", "old_bytes", "old_mtime")


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): files new or with another hash, and files that are gone."""
    old = stored.select("path", F.col("hash").alias("old_hash"))
    live = current.select("path", "hash").join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old_hash")))
    gone = old.join(current.select("path"), "path", "left_anti").select("path", F.lit("gone").alias("change"))
    return live.select("path", F.when(F.col("old_hash").isNull(), "new").otherwise("changed").alias("change")).unionByName(gone)


def read_one(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The row ``walk`` gives for a single file, without listing the others."""
    stat = os.stat(os.path.join(root, path))
    one = spark.createDataFrame([(path, stat.st_size, stat.st_mtime_ns // 1000)], "path string, bytes long, mtime long")
    return read_listed(one, root).drop("content", "lines")
