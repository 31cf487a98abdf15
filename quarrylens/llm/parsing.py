"""Source files that do not parse: flags for each file, rates for each repository and language.

Bundled grammars compile to table-driven parsers that read the whole token stream of a
file and report the first token no valid file has there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.syntax.check import first_error
from quarrylens.operators.incremental import normal_path
from quarrylens.runtime import parallel, pick


def parse_files(discovered: DataFrame) -> DataFrame:
    """(file_id, repo, path, lang, error_line): every row, with the line of its first error or null.

    Null and empty contents, files of comments only and languages without a grammar are
    valid. Repeated rows come out repeated.
    """
    rows = parallel(pick(discovered, "file_id", "repo", "path", "lang", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [first_error(c, g) for g, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lines, pa.int32())], ["file_id", "repo", "path", "lang", "error_line"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4])
    return rows.mapInArrow(run, f"{fields}, error_line int")


def reported_errors(index_reports: DataFrame) -> DataFrame:
    """(repo, path) that a report names with a parse error; entries without ``path: message`` name none."""
    rows = pick(index_reports, "repo", "parse_errors").where("repo is not null")
    entry = rows.select("repo", F.explode("parse_errors").alias("entry")).where("entry is not null")
    path = F.regexp_extract("entry", r"^(.+?): ", 1)
    return entry.select("repo", normal_path(path).alias("path")).where("path <> ''").distinct()


def checked_files(discovered: DataFrame, index_reports: DataFrame) -> DataFrame:
    """One row for each file: file_id, repo, path, lang, error_line, invalid and reported (whether a report names it)."""
    parsed = parse_files(discovered).withColumn("path", normal_path(F.col("path")))
    one = parsed.groupBy("file_id", "repo", "path", "lang").agg(F.max("error_line").alias("error_line"))
    known = reported_errors(index_reports).withColumn("reported", F.lit(True))
    return one.join(known, ["repo", "path"], "left").select(
        "file_id", "repo", "path", "lang", "error_line", F.col("error_line").isNotNull().alias("invalid"), F.coalesce("reported", F.lit(False)).alias("reported")
    )


def parse_rates(discovered: DataFrame, index_reports: DataFrame) -> DataFrame:
    """For each repository and language: files, invalid, reported, reported_invalid and invalid_share."""
    return (
        checked_files(discovered, index_reports)
        .groupBy("repo", "lang")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if("invalid").alias("invalid"),
            F.count_if("reported").alias("reported"),
            F.count_if(F.col("invalid") & F.col("reported")).alias("reported_invalid"),
        )
        .withColumn("invalid_share", F.round(F.col("invalid") / F.col("files"), 6))
    )


def found(discovered: DataFrame) -> DataFrame:
    """(file_id) of the files that are not valid in their language."""
    return parse_files(discovered).where("error_line is not null and file_id is not null").select("file_id").distinct()
