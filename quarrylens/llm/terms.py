"""How distinctive a term is per record: correspondence-analysis residuals.

For a record r and a term t with n uses, row margin n_r, column margin n_t and N uses in
all, the expected count is n_r * n_t / N. The residual (n - expected) / sqrt(expected) is
divided by sqrt((1 - n_r/N) * (1 - n_t/N)), which gives it unit variance under
independence: terms that every record uses score near zero, rare shared ones high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import cut, pick, salted_join


def terms_of(text: Column) -> Column:
    """Runs of at least three letters in lower case, one plural ``s`` dropped; null gives null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1))
    return F.transform(words, _singular)


def _singular(word: Column) -> Column:
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.left(word, F.length(word) - 1)).otherwise(word)


def commit_terms(commits: DataFrame) -> DataFrame:
    """(record_kind, repo, record_key, uses): one record for each sha, whatever its letter case.

    Deliveries of one commit are one record; the latest one that has a subject counts
    (ties: the greater subject). Commits without sha, and those without subject in any
    delivery, hold no terms and are left out.
    """
    rows = pick(commits, "sha", "repo", "subject", "ingested_at").where("sha is not null and subject is not null")
    return (
        rows.groupBy(F.lower("sha").alias("record_key"))
        .agg(F.max(F.struct("ingested_at", "subject", "repo")).alias("r"))
        .select(F.lit("commit").alias("record_kind"), "r.repo", "record_key", terms_of(F.col("r.subject")).alias("uses"))
    )


def file_terms(file_extracts: DataFrame) -> DataFrame:
    """(record_kind, repo, record_key, uses): the latest extract of each (repo, path).

    Ties of ``extracted_at`` take the greater extract_id. Null vocabularies are empty;
    rows without path are left out.
    """
    rows = pick(file_extracts, "repo", "path", "extract_id", "vocabulary", "extracted_at").where("path is not null")
    last = rows.groupBy("repo", "path").agg(F.max(F.struct("extracted_at", "extract_id", "vocabulary")).alias("r"))
    words = F.flatten(F.transform(F.filter("r.vocabulary", lambda w: w.isNotNull()), terms_of))
    return last.select(F.lit("file").alias("record_kind"), "repo", F.col("path").alias("record_key"), words.alias("uses"))


def distinctive_terms(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each record and term it uses, with counts and adjusted residual.

    ``records`` has the key columns and ``uses``, an array with one entry for each use of
    a term. Records without uses give no rows; an empty input gives an empty result. Out:
    keys, term, uses, record_uses, term_uses, term_records, expected, residual. A residual
    whose variance is zero (one record or one term holds every use) is 0.
    """
    counts = cut(
        records.where(F.size("uses") > 0)
        .select(*keys, F.size("uses").cast("long").alias("record_uses"), F.explode("uses").alias("term"))
        .groupBy(*keys, "term", "record_uses")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    terms = counts.groupBy("term").agg(F.sum("uses").alias("term_uses"), F.count(F.lit(1)).alias("term_records"))
    totals = counts.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("total_uses"), F.count(F.lit(1)).alias("total_rows"))
    sized = terms.select("term", F.col("term_records").alias("__rows")).crossJoin(F.broadcast(totals.select("total_rows")))
    scored = salted_join(counts, terms, ["term"], sized, F.col("total_rows"), keys).crossJoin(F.broadcast(totals.select("total_uses")))
    expected = F.col("record_uses").cast("double") * F.col("term_uses") / F.col("total_uses")
    spread = (1 - F.col("record_uses") / F.col("total_uses")) * (1 - F.col("term_uses") / F.col("total_uses"))
    return scored.withColumn("expected", expected).select(
        *keys, "term", "uses", "record_uses", "term_uses", "term_records", "expected",
        F.when(spread > 0, (F.col("uses") - F.col("expected")) / F.sqrt(F.col("expected") * spread)).otherwise(F.lit(0.0)).alias("residual"),
    )


KEYS = ["record_kind", "repo", "record_key"]


def scored_records(commits: DataFrame, file_extracts: DataFrame) -> DataFrame:
    """Scores of both collections: commits by their subjects, files by their vocabularies."""
    return distinctive_terms(commit_terms(commits), KEYS).unionByName(distinctive_terms(file_terms(file_extracts), KEYS))


def rare_shared(commits: DataFrame, file_extracts: DataFrame, low: int = 2, high: int = 12, file_uses: int = 5) -> DataFrame:
    """The scored rows of rare shared terms, with their residuals: terms held by ``low`` to ``high``
    records; in files used ``file_uses`` times at least. Materialised once, so rankings by residual read it."""
    rows = scored_records(commits, file_extracts)
    return cut(rows.where(F.col("term_records").between(low, high) & ((F.col("record_kind") == "commit") | (F.col("uses") >= file_uses))))


def found(commits: DataFrame, file_extracts: DataFrame) -> DataFrame:
    """(record_kind, repo, record_key, term) of the rare shared terms of each record."""
    return rare_shared(commits, file_extracts).where("not isnan(residual)").select(*KEYS, "term")


def scores(commits: DataFrame, file_extracts: DataFrame) -> DataFrame:
    """Every term of every record with its counts and its residual to six places."""
    return scored_records(commits, file_extracts).select(*KEYS, "term", "uses", "term_uses", "term_records", F.round("residual", 6).alias("residual"))
