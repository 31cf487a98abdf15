"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import bpe, cooccur, language, mixture, pairs, parsing, provenance, repetition, terms
from quarrylens.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: terms.found(table(s, d, "commits"), table(s, d, "file_extracts")),
        "p1_scores": lambda s, d: terms.scores(table(s, d, "commits"), table(s, d, "file_extracts")),
        "p3_found": lambda s, d: language.found(table(s, d, "sections")),
        "p4_found": lambda s, d: cooccur.found(table(s, d, "commits")),
        "p5_found": lambda s, d: provenance.found(table(s, d, "discovered"), table(s, d, "files")),
        "p6_found": lambda s, d: parsing.found(table(s, d, "discovered")),
        "p6_rates": lambda s, d: parsing.parse_rates(table(s, d, "discovered"), table(s, d, "index_reports")),
        "p7_found": lambda s, d: pairs.found(table(s, d, "nodes"), table(s, d, "why_answers"), table(s, d, "discovered")),
        "p7_captured": lambda s, d: pairs.captured(table(s, d, "nodes"), table(s, d, "why_answers"), table(s, d, "discovered")),
        "p8_ids": lambda s, d: bpe.encode(table(s, d, "documents")),
        "p9_mixture": lambda s, d: mixture.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: repetition.found(table(s, d, "documents")),
        "p10_recall": lambda s, d: repetition.recall(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_COUNTED + P1_FOUND, "p1_scores": P1_COUNTED + P1_SCORES, "p4_found": P4_FOUND}


P1_COUNTED = r"""
WITH last_commit AS (
  SELECT lower(sha) AS record_key, arg_max(repo, (ingested_at, subject)) AS repo, arg_max(subject, (ingested_at, subject)) AS subject
  FROM commits WHERE sha IS NOT NULL AND subject IS NOT NULL GROUP BY 1),
commit_words AS (
  SELECT record_key, repo, unnest(regexp_extract_all(lower(subject), '\p{L}{3,}')) AS w FROM last_commit),
last_file AS (
  SELECT repo, path, arg_max(vocabulary, (extracted_at, extract_id)) AS vocabulary
  FROM file_extracts WHERE path IS NOT NULL GROUP BY 1, 2),
file_entries AS (SELECT repo, path, unnest(vocabulary) AS entry FROM last_file),
file_words AS (SELECT repo, path, unnest(regexp_extract_all(lower(entry), '\p{L}{3,}')) AS w FROM file_entries),
uses AS (
  SELECT 'commit' AS record_kind, repo, record_key, w FROM commit_words
  UNION ALL SELECT 'file', repo, path, w FROM file_words),
counted AS (
  SELECT record_kind, repo, record_key,
         CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS term,
         count(*) AS n
  FROM uses GROUP BY 1, 2, 3, 4),
spread AS (SELECT record_kind, term, count(*) AS records, sum(n) AS term_uses FROM counted GROUP BY 1, 2)
"""

P1_FOUND = """
SELECT record_kind, repo, record_key, term FROM counted JOIN spread USING (record_kind, term)
WHERE records BETWEEN 2 AND 12 AND (record_kind = 'commit' OR n >= 5)
"""

P1_SCORES = """,
sized AS (SELECT record_kind, repo, record_key, sum(n) AS record_uses FROM counted GROUP BY 1, 2, 3),
totals AS (SELECT record_kind, sum(n) AS total FROM counted GROUP BY 1),
whole AS (
  SELECT c.record_kind, c.repo, c.record_key, c.term, n, term_uses, records, total,
         record_uses * term_uses / total::DOUBLE AS expected,
         (1 - record_uses / total::DOUBLE) * (1 - term_uses / total::DOUBLE) AS room
  FROM counted c
  JOIN sized s ON s.record_kind = c.record_kind AND s.repo IS NOT DISTINCT FROM c.repo AND s.record_key = c.record_key
  JOIN spread t ON t.record_kind = c.record_kind AND t.term = c.term
  JOIN totals g ON g.record_kind = c.record_kind)
SELECT record_kind, repo, record_key, term, n AS uses, term_uses::BIGINT AS term_uses, records AS term_records,
       round(CASE WHEN room > 0 THEN (n - expected) / sqrt(expected * room) ELSE 0 END, 6) AS residual
FROM whole
"""

P4_FOUND = """
WITH baskets AS (SELECT DISTINCT lower(sha) AS sha, repo FROM commits WHERE sha IS NOT NULL AND repo IS NOT NULL),
totals AS (SELECT repo, count(*) AS total FROM baskets GROUP BY 1),
opened AS (SELECT lower(sha) AS sha, repo, unnest(files) AS path FROM commits WHERE sha IS NOT NULL AND repo IS NOT NULL),
items AS (SELECT DISTINCT sha, repo, path FROM opened WHERE path IS NOT NULL),
counts AS (SELECT repo, path, count(*) AS n FROM items GROUP BY 1, 2),
pairs AS (
  SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS shared
  FROM items a JOIN items b ON a.sha = b.sha AND a.repo = b.repo AND a.path < b.path GROUP BY 1, 2, 3)
SELECT p.repo, path_a, path_b
FROM pairs p JOIN totals t ON p.repo = t.repo
JOIN counts ca ON ca.repo = p.repo AND ca.path = path_a
JOIN counts cb ON cb.repo = p.repo AND cb.path = path_b
WHERE shared >= 5 AND shared * total >= 3 * ca.n * cb.n
"""
