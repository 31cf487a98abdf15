"""Resolving what sources refer to: names to symbols, modules to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.incremental import normal_path


def _family(lang):
    """TypeScript and JavaScript are one language where names are looked up."""
    return F.when(lang == "typescript", "javascript").otherwise(lang)


#: More candidates than this say nothing about which one is meant.
MAX_CANDIDATES = 5


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_uid, uid, kind, confidence, status) of the symbols references mean.

    refs: from_uid, name, path, lang, kind. A single match in the same file is meant with
    confidence .95, one in all files with .9, each of up to five with 1/n; more are dropped.
    Matches in the same file hide those elsewhere. The size of a name's candidate list is
    checked before the join, so a frequent name is never joined with all who use it.
    """
    named = symbols.select("name", F.col("path").alias("symbol_path"), "uid", _family(F.col("lang")).alias("family"))
    wide = named.groupBy("name", "family").agg(F.count(F.lit(1)).alias("n"))
    wanted = refs.withColumn("ref", F.xxhash64("from_uid", "name", "path", "kind")).withColumn("family", _family(F.col("lang"))).join(wide, ["name", "family"])
    local = wanted.join(named.withColumnRenamed("symbol_path", "path"), ["name", "family", "path"]).select("ref", "from_uid", "kind", "uid")
    local = local.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("ref")))
    local_edges = local.where(F.col("found") <= MAX_CANDIDATES).withColumn("confidence", F.when(F.col("found") == 1, 0.95).otherwise(1.0 / F.col("found")))
    other = wanted.where(F.col("n") <= MAX_CANDIDATES).join(local.select("ref").distinct(), "ref", "left_anti").join(named, ["name", "family"]).select("ref", "from_uid", "kind", "uid", "n")
    other_edges = other.withColumn("confidence", F.when(F.col("n") == 1, 0.9).otherwise(1.0 / F.col("n")))
    rows = local_edges.select("from_uid", "uid", "kind", "confidence").unionByName(other_edges.select("from_uid", "uid", "kind", "confidence"))
    status = F.when(F.col("confidence") >= 0.9, "CONFIRMED").otherwise("INFERRED")
    return rows.groupBy("from_uid", "uid", "kind").agg(F.max("confidence").alias("confidence")).withColumn("status", status)


def tested_by(calls: DataFrame, nodes: DataFrame, is_test) -> DataFrame:
    """(src, dst, confidence) from production symbols to the tests that call them."""
    at = nodes.select("uid", "path")
    ends = calls.where("kind = 'CALLS'").join(at.select(F.col("uid").alias("from_uid"), F.col("path").alias("test_path")), "from_uid").join(at, "uid")
    return ends.where(is_test(F.col("test_path")) & ~is_test(F.col("path"))).select(F.col("uid").alias("src"), F.col("from_uid").alias("dst"), "confidence")


def touched_references(refs: DataFrame, names: DataFrame, paths: DataFrame, most: int = 400) -> DataFrame:
    """References an edit can move: by one of the names or in one of the paths; all of them beyond ``most`` names."""
    if names.limit(most + 1).count() > most:
        return refs
    keyed = refs.withColumn("__ref", F.xxhash64(*refs.columns))
    hit = keyed.join(names.select("name"), "name", "left_semi").select("__ref").union(keyed.join(paths.select("path"), "path", "left_semi").select("__ref")).distinct()
    return keyed.join(hit, "__ref", "left_semi").drop("__ref")


def module_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, module): the file each imported module means.

    A module may be a path without ending, relative to the importing file or to the root,
    in dots or slashes, or a folder's index; the first spelling that is a file counts.
    """
    module = F.regexp_replace("module", r"^[\"']|[\"']$", "")
    base = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    plain = F.when(module.rlike(r"^\.{0,2}/"), module).otherwise(F.translate(module, ".", "/"))
    relative = normal_path(F.concat(base, F.regexp_replace(plain, r"^\./", "")))
    stems = F.array_distinct(F.array(relative, plain, F.concat(relative, F.lit("/index")), F.concat(plain, F.lit("/__init__")), F.concat(relative, F.lit("/__init__")), F.concat(plain, F.lit("/mod"))))
    asked = imports.where("path is not null and module is not null").select("path", "module", F.posexplode(stems).alias("place", "stem"))
    known = files.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.col("path").alias("target")).distinct()
    hit = asked.join(known, "stem").where("target <> path")
    return hit.groupBy("path", "module").agg(F.min(F.struct("place", "target")).alias("m")).select("path", F.col("m.target").alias("target"), "module")


def known_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose source is a node, each once."""
    return refs.join(nodes.select(F.col("uid").alias("from_uid")), "from_uid", "left_semi").distinct()
