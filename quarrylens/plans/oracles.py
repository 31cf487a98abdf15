"""SQL that DuckDB runs on the same tables, by query name."""

from __future__ import annotations

from quarrylens.functions import lexicon as lex
from quarrylens.operators.search import ACCENTED, PLAIN

_RUNS = """
last_row AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC NULLS LAST, finished_at DESC NULLS LAST, status DESC NULLS LAST) AS rn
  FROM index_runs WHERE run_id IS NOT NULL),
runs AS (
  SELECT repo, run_id, lag(run_id) OVER (PARTITION BY repo ORDER BY started_at NULLS FIRST, run_id) AS before,
         row_number() OVER (PARTITION BY repo ORDER BY started_at DESC NULLS LAST, run_id DESC) AS back
  FROM last_row WHERE rn = 1 AND lower(trim(status)) = 'ok' AND finished_at IS NOT NULL AND repo IS NOT NULL),
listed AS (
  SELECT repo, run_id, regexp_replace(replace(path, '\\', '/'), '^(?:\\./+)+', '') AS path, lower(hash) AS hash, bytes, mtime, listed_at
  FROM files WHERE run_id IS NOT NULL AND path IS NOT NULL),
listing AS (
  SELECT run_id, path, hash FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY listed_at DESC NULLS LAST, hash DESC NULLS LAST) AS rn FROM listed)
  WHERE rn = 1)""".replace("\\\\", "\\")

_COMMITS = """
commit_rows AS (
  SELECT lower(sha) AS sha, repo, authored_ts, subject, files,
         row_number() OVER (PARTITION BY lower(sha) ORDER BY ingested_at DESC, repo DESC, authored_ts DESC, subject DESC NULLS LAST) AS rn
  FROM commits WHERE sha IS NOT NULL),
c AS (SELECT sha, repo, authored_ts, subject, list_distinct(coalesce(files, []::VARCHAR[])) AS files FROM commit_rows WHERE rn = 1),
cf AS (SELECT DISTINCT sha, repo, authored_ts, subject, unnest(files) AS path FROM c)"""


def _class(s: str) -> str:
    prefix = f"trim(regexp_extract({s}, '^([^:(]*)', 1))"
    return f"""CASE WHEN starts_with({s}, 'revert') OR contains({s}, 'this reverts commit') THEN 'revert'
      WHEN {prefix} IN ('fix', 'bugfix', 'hotfix', 'patch') THEN 'fix' WHEN {prefix} IN ('feat', 'feature') THEN 'feature'
      WHEN {prefix} IN ('refactor', 'perf') THEN 'refactor' WHEN {prefix} IN ('docs', 'doc') THEN 'docs' WHEN {prefix} IN ('test', 'tests') THEN 'test'
      WHEN {prefix} IN ('chore', 'ci', 'build', 'style', 'deps') THEN 'chore'
      WHEN contains({s}, 'fix') OR contains({s}, 'bug') OR contains({s}, 'issue #') OR contains({s}, 'regression') THEN 'fix'
      WHEN contains({s}, 'refactor') OR contains({s}, 'cleanup') OR contains({s}, 'clean up') THEN 'refactor'
      WHEN contains({s}, 'add ') OR contains({s}, 'implement') OR contains({s}, 'introduce') THEN 'feature' ELSE 'other' END"""


def _split(name: str) -> str:
    """Words of an identifier; borders are marked in turns, as the patterns have no look-around."""
    t = f"regexp_replace({name}, '[_\\-. ]+', ' ', 'g')"
    for pattern in ("([\\p{Ll}0-9])(\\p{Lu})", "(\\p{Lu})(\\p{Lu}\\p{Ll})", "([0-9])([^0-9 ])", "([^0-9 ])([0-9])"):
        t = f"regexp_replace({t}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower(trim({t})), ' '), lambda w: strlen(w) > 1)"


def _stem(w: str) -> str:
    return f"CASE WHEN strlen({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"


_STOP = "[" + ", ".join(f"'{w}'" for w in lex.STOPWORD_LIST) + "]"


def _meaningful(text: str) -> str:
    raw = f"list_filter(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}_\\-]+'), lambda r: r <> '')"
    words = f"flatten(list_transform({raw}, lambda r: {_split('r')}))"
    return f"list_sort(list_distinct(list_filter({words}, lambda v: length(v) >= 3 AND NOT list_contains({_STOP}, v))))"


_DOC_TOKENS = "docs AS (SELECT doc_id, source, text, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}') AS t FROM documents WHERE text IS NOT NULL)"
_BM25 = f"""{_DOC_TOKENS},
sized AS (SELECT doc_id, source, len(t) AS dl, t FROM docs WHERE len(t) > 0),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
tf AS (SELECT doc_id, q, len(list_filter(t, lambda x: x = q)) AS f, dl FROM sized, (VALUES ('approval'), ('discount'), ('warehouse')) v(q)),
df AS (SELECT q, count(*) AS d FROM tf WHERE f > 0 GROUP BY q),
parts AS (
  SELECT doc_id, tf.q, ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s
  FROM tf JOIN df ON tf.q = df.q, whole WHERE f > 0),
bm AS (SELECT doc_id, round(sum(s), 4) AS score, CAST(count(*) AS INTEGER) AS matched FROM parts GROUP BY doc_id)"""

_NODES = """
n AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY node_id DESC, kind DESC, name DESC, path DESC, line_start DESC, line_end DESC) AS rn,
         max(confidence) OVER (PARTITION BY uid) AS top FROM nodes WHERE uid IS NOT NULL) WHERE rn = 1),
st AS (SELECT uid, arg_max(status, (confidence, node_id, status)) AS top_status FROM nodes WHERE uid IS NOT NULL GROUP BY uid)"""

_EDGES = f"""{_NODES},
spans AS (SELECT uid, path, line_start, line_end FROM n WHERE kind = 'Symbol'),
nest AS (
  SELECT src, dst FROM (
    SELECT o.uid AS src, i.uid AS dst, row_number() OVER (PARTITION BY i.uid ORDER BY o.line_end - o.line_start, o.uid) AS rn
    FROM spans i JOIN spans o ON i.path = o.path AND i.uid <> o.uid AND o.line_start <= i.line_start AND o.line_end >= i.line_end
      AND (o.line_start < i.line_start OR o.line_end > i.line_end)) WHERE rn = 1),
present AS (SELECT repo, path, arg_max(content, (mtime, content)) AS content, arg_max(lang, (mtime, content)) AS lang FROM discovered WHERE path IS NOT NULL GROUP BY 1, 2),
used AS (SELECT DISTINCT 'file:' || path AS from_uid, path, lang, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS name FROM present WHERE content IS NOT NULL),
refs AS (SELECT *, CASE WHEN lang = 'typescript' THEN 'javascript' ELSE lang END AS family FROM used),
syms AS (SELECT uid, name, path, CASE WHEN lang = 'typescript' THEN 'javascript' ELSE lang END AS family FROM n WHERE kind = 'Symbol'),
hits AS (
  SELECT from_uid, s.uid, r.name, s.path = r.path AS own, count(*) OVER (PARTITION BY from_uid, r.name) AS all_n,
         sum(CASE WHEN s.path = r.path THEN 1 ELSE 0 END) OVER (PARTITION BY from_uid, r.name) AS own_n
  FROM refs r JOIN syms s ON s.name = r.name AND s.family = r.family),
resolved AS (
  SELECT from_uid, uid, max(CASE WHEN own_n = 1 THEN 0.95 WHEN own_n > 1 THEN 1.0 / own_n WHEN all_n = 1 THEN 0.9 ELSE 1.0 / all_n END) AS confidence
  FROM hits WHERE (own_n > 0 AND own AND own_n <= 5) OR (own_n = 0 AND all_n <= 5) GROUP BY 1, 2),
calls AS (
  SELECT src, dst, max(confidence) AS confidence FROM (
    SELECT src, dst, 0.5 AS confidence FROM nest UNION ALL
    SELECT from_uid, r.uid, confidence FROM resolved r WHERE from_uid IN (SELECT uid FROM n)) GROUP BY 1, 2)""".replace("\\\\", "\\")

_CO = f"""{_COMMITS},
small AS (SELECT sha, repo, path FROM cf WHERE sha IN (SELECT sha FROM c WHERE len(files) BETWEEN 2 AND 20)),
pairs AS (
  SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS support
  FROM small a JOIN small b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""

_OUTCOMES = f"""{_CO},
both_ways AS (SELECT repo, path_a AS q, path_b AS path, support FROM pairs UNION ALL SELECT repo, path_b, path_a, support FROM pairs),
arms AS (
  SELECT repo, q, path, 'often' AS condition, row_number() OVER (PARTITION BY repo, q ORDER BY support DESC, path) AS place FROM both_ways
  UNION ALL SELECT repo, q, path, 'named', row_number() OVER (PARTITION BY repo, q ORDER BY path) FROM both_ways),
tasks AS (SELECT sha AS task, repo, list_sort(files) AS f FROM c WHERE len(files) BETWEEN 2 AND 6),
truth AS (SELECT task, unnest(f[2:]) AS path FROM tasks),
offers AS (SELECT t.task, a.condition, a.path, a.place, length(a.path) AS tokens FROM tasks t JOIN arms a ON a.repo = t.repo AND a.q = t.f[1] WHERE a.place <= 5),
marked AS (
  SELECT o.*, tr.path IS NOT NULL AS hit, sum(tokens) OVER (PARTITION BY o.task, condition ORDER BY place) AS cost
  FROM offers o LEFT JOIN truth tr ON tr.task = o.task AND tr.path = o.path),
scored AS (
  SELECT task, condition, count(DISTINCT CASE WHEN hit THEN path END) AS hits, min(CASE WHEN hit THEN place END) AS first_hit_rank,
         CAST(min(CASE WHEN hit THEN cost END) AS BIGINT) AS tokens_to_first_hit, CAST(sum(tokens) AS BIGINT) AS tokens_total, count(*) AS files, count(*) FILTER (NOT hit) AS wrong_files
  FROM marked GROUP BY 1, 2),
need AS (SELECT task, count(*) AS need FROM truth GROUP BY 1),
outcomes AS (
  SELECT task, condition, round(hits / need, 4) AS recall, round(hits / files, 4) AS precision, first_hit_rank, tokens_to_first_hit, tokens_total, files, wrong_files
  FROM scored JOIN need USING (task))"""
_MEDIAN = "list_sort(list({0}) FILTER ({0} IS NOT NULL))[len(list({0}) FILTER ({0} IS NOT NULL)) // 2 + 1]"


def _extension() -> str:
    ext = "regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]*)$', 1)"
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in exts.split())}) THEN '{lang}'" for lang, exts in lex.EXTENSIONS.items()) + " ELSE 'other' END"


_TEST = "(regexp_matches(lower(path), '(^|/)(test|tests|__tests__|spec|specs)(/|$)') OR regexp_matches(regexp_extract(lower(path), '[^/]*$'), '^test_|^test\\.|_test\\.|\\.test\\.|\\.spec\\.|(test|tests|it)\\.java$|(test|tests)\\.cs$|test\\.kt$|_spec\\.rb$|test\\.php$'))"
_SPEC = "NOT (" + " OR ".join(f"contains(lower(path), '{m}')" for m in lex.HISTORICAL_MARKS) + ")"
_FOLDER = "(" + " OR ".join(f"list_contains(string_split(regexp_replace(path, '[^/]*$', ''), '/'), '{f}')" for f in lex.EXCLUDED_FOLDERS) + ")"
_SUFFIX = "(" + " OR ".join(f"ends_with(path, '{x}')" for x in lex.EXCLUDED_SUFFIXES) + ")"
_WORDS3 = "(VALUES ('approval'), ('discount'), ('warehouse')) v(q)"

ORACLES = {
    "p2_found": f"""WITH {_RUNS}
        SELECT r.run_id, l.path FROM runs r JOIN listing l ON l.run_id = r.run_id
        LEFT JOIN listing p ON p.run_id = r.before AND p.path = l.path AND p.hash IS NOT DISTINCT FROM l.hash
        WHERE r.before IS NOT NULL AND p.run_id IS NULL""",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, score, matched FROM bm ORDER BY score DESC, doc_id LIMIT 20",
    "bm25_coverage_rank": f"WITH {_BM25} SELECT doc_id, matched, round(score / (SELECT max(score) FROM bm) * (0.35 + 0.65 * matched / 3), 4) AS rank_score FROM bm",
    "file_aggregate_top3": f"""WITH {_BM25}, r AS (SELECT source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM bm JOIN sized USING (doc_id) WHERE source IS NOT NULL)
        SELECT source, round(sum(score), 4) AS score FROM r WHERE rn <= 3 GROUP BY source""",
    "offer_cutoff": f"""WITH {_BM25}, r AS (SELECT source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM bm JOIN sized USING (doc_id) WHERE source IS NOT NULL),
        f AS (SELECT source, round(sum(score), 4) AS score FROM r WHERE rn <= 3 GROUP BY source) SELECT source, score FROM f WHERE score >= 0.5 * (SELECT max(score) FROM f)""",
    "pack_context": f"""WITH {_BM25}, top AS (SELECT doc_id, score FROM bm),
        p AS (SELECT doc_id, length(text) AS size, sum(length(text)) OVER (ORDER BY score DESC, doc_id) AS e FROM top JOIN docs USING (doc_id))
        SELECT doc_id, CAST(least(size, 12000 - (e - size)) AS BIGINT) AS taken FROM p WHERE e - size < 12000""",
    "substring_fallback": """SELECT doc_id, CAST(m AS INTEGER) AS matched FROM (
        SELECT doc_id, contains(lower(text), 'entrep')::INT + contains(lower(text), 'schreib')::INT + contains(lower(text), 'almac')::INT + contains(lower(text), 'kho')::INT AS m FROM documents WHERE text IS NOT NULL AND strlen(text) <> length(text))
        WHERE m > 0 ORDER BY m DESC, doc_id LIMIT 60""",
    "content_scan": f"""WITH present AS (SELECT repo, path, arg_max(content, (mtime, content)) AS content FROM discovered WHERE path IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT path, q, least((length(lower(content)) - length(replace(lower(content), q, ''))) // length(q), 50) AS u FROM present, {_WORDS3} WHERE content IS NOT NULL),
        g AS (SELECT path, count(*) FILTER (u > 0) AS distinct_terms, CAST(sum(u) AS BIGINT) AS uses FROM k GROUP BY path),
        s AS (SELECT *, distinct_terms + uses / 200 AS raw FROM g WHERE distinct_terms > 0)
        SELECT path, distinct_terms, uses, round(raw / (SELECT max(raw) FROM s), 4) AS score FROM s ORDER BY distinct_terms DESC, uses DESC, path LIMIT 50""",
    "path_scan": """WITH present AS (SELECT DISTINCT repo, path FROM discovered WHERE path IS NOT NULL),
        k AS (SELECT path, CAST(contains(lower(path), 'tax')::INT + contains(lower(path), 'order')::INT + contains(lower(path), 'approve')::INT AS INTEGER) AS matched FROM present)
        SELECT path, matched FROM k WHERE matched > 0 ORDER BY matched DESC, path LIMIT 40""",
    "token_totals": r"""SELECT lang, CAST(sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(strlen(n) / 4.0) + ceil((length(text) - length(n)) / 1.5)) END) AS BIGINT) AS tokens
        FROM (SELECT lang, text, regexp_replace(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]', '', 'g') AS n FROM documents WHERE text IS NOT NULL) GROUP BY lang""",
    "text_functions": f"""WITH d AS (SELECT DISTINCT name FROM nodes)
        SELECT name, array_to_string({_split('name')}, ' ') AS words, CASE WHEN i = '' THEN 'CONCEPT' ELSE i END AS concept, CASE WHEN g = '' THEN 'section' ELSE g END AS slug,
               array_to_string(list_transform({_split('name')}, lambda w: {_stem('w')}), ' ') AS stems
        FROM (SELECT name, trim(regexp_replace(upper(name), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS i, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') AS g FROM d)""",
    "subject_words": f"WITH d AS (SELECT DISTINCT subject FROM commits WHERE subject IS NOT NULL) SELECT subject, array_to_string({_meaningful('subject')}, ' ') AS words, {_class('lower(trim(subject))')} AS change_class FROM d",
    "path_predicates": f"""WITH {_RUNS}, d AS (SELECT DISTINCT path FROM listed) SELECT {_extension()} AS lang, count(*) AS paths, count(*) FILTER ({_TEST}) AS tests, count(*) FILTER ({_SPEC}) AS specifications FROM d GROUP BY 1""",
    "file_skip_summary": f"""WITH d AS (SELECT DISTINCT path, content FROM discovered WHERE path IS NOT NULL),
        r AS (SELECT CASE WHEN {_FOLDER} THEN 'folder' WHEN {_SUFFIX} THEN 'generated' WHEN strlen(coalesce(content, '')) > {lex.MAX_FILE_BYTES} THEN 'large' WHEN contains(content, chr(0)) THEN 'binary' END AS reason FROM d)
        SELECT reason, count(*) AS files FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "changed_files": f"""WITH {_RUNS}, k AS (SELECT r.repo || ' ' || l.path AS path, l.hash, r.back FROM listing l JOIN runs r ON r.run_id = l.run_id WHERE r.back <= 2),
        a AS (SELECT * FROM k WHERE back = 1), b AS (SELECT * FROM k WHERE back = 2)
        SELECT a.path, CASE WHEN b.hash IS NULL THEN 'new' ELSE 'changed' END AS change FROM a LEFT JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash
        UNION ALL SELECT path, 'gone' FROM b WHERE path NOT IN (SELECT path FROM a)""",
    "stat_skip": f"""WITH {_RUNS}, one AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, run_id, path ORDER BY listed_at DESC NULLS LAST, hash DESC NULLS LAST, bytes DESC NULLS LAST, mtime DESC NULLS LAST) AS rn FROM listed) WHERE rn = 1),
        k AS (SELECT one.repo, path, bytes, mtime, back FROM one JOIN runs ON runs.run_id = one.run_id WHERE back <= 2)
        SELECT a.repo, count(*) AS files, count(*) FILTER (coalesce(a.mtime <> 0 AND a.mtime = b.mtime AND a.bytes = b.bytes, false)) AS spared
        FROM (SELECT * FROM k WHERE back = 1) a LEFT JOIN (SELECT * FROM k WHERE back = 2) b ON a.repo = b.repo AND a.path = b.path GROUP BY 1""",
    "node_upsert": f"WITH {_NODES} SELECT uid, kind, name, path, top_status AS status, round(top, 4) AS confidence FROM n JOIN st USING (uid)",
    "kind_counts": f"WITH {_NODES} SELECT kind, count(*) AS nodes FROM n GROUP BY kind",
    "innermost_span": f"""WITH {_NODES}, p AS (SELECT DISTINCT regexp_extract(location, '^(.*):(\\d+)$', 1) AS path, CAST(regexp_extract(location, '^(.*):(\\d+)$', 2) AS INTEGER) + 1 AS line FROM why_answers WHERE location IS NOT NULL)
        SELECT path, line, uid FROM (SELECT p.path, p.line, n.uid, row_number() OVER (PARTITION BY p.path, p.line ORDER BY line_end - line_start, n.uid) AS r FROM p JOIN n ON n.path = p.path AND n.kind = 'Symbol' AND p.line BETWEEN line_start AND line_end) WHERE r = 1""",
    "nesting": f"WITH {_EDGES} SELECT src, dst FROM nest",
    "resolve_refs": f"WITH {_EDGES} SELECT from_uid, uid, round(confidence, 4) AS confidence FROM resolved",
    "unresolved": f"WITH {_COMMITS} SELECT 'file:' || path AS src, count(DISTINCT left(sha, 12)) AS commits FROM cf WHERE 'file:' || path NOT IN (SELECT uid FROM nodes WHERE uid IS NOT NULL) GROUP BY 1",
    "impact_reach": f"""WITH RECURSIVE {_EDGES}, walk AS (
          SELECT uid, 0 AS distance FROM n WHERE kind = 'Symbol' AND lower(name) LIKE 'release%'
          UNION SELECT calls.src, distance + 1 FROM walk JOIN calls ON calls.dst = walk.uid WHERE distance < 2),
        best AS (SELECT uid, min(distance) AS distance FROM walk GROUP BY uid) SELECT CAST(distance AS INTEGER) AS distance, count(*) AS nodes, min(uid) AS first FROM best GROUP BY 1""",
    "flow_entries": f"WITH {_EDGES} SELECT uid FROM n WHERE kind = 'Symbol' AND uid NOT IN (SELECT dst FROM calls WHERE src <> dst AND src IN (SELECT uid FROM n WHERE kind = 'Symbol'))",
    "spread_two_hops": f"""WITH {_EDGES}, links AS (SELECT src AS a, dst AS b, confidence FROM calls UNION ALL SELECT dst, src, confidence FROM calls),
        s0 AS (SELECT uid, 1.0 AS score FROM n WHERE kind = 'Symbol' AND lower(name) LIKE '%approval%'),
        h1 AS (SELECT b AS uid, max(score * 0.75 * confidence) AS score FROM s0 JOIN links ON a = uid WHERE score * 0.75 * confidence >= 0.02 GROUP BY 1),
        f1 AS (SELECT h1.* FROM h1 LEFT JOIN s0 USING (uid) WHERE s0.score IS NULL OR h1.score > s0.score),
        s1 AS (SELECT uid, max(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM f1) GROUP BY 1),
        h2 AS (SELECT b AS uid, max(score * 0.75 * confidence * 0.55) AS score FROM f1 JOIN links ON a = uid WHERE score * 0.75 * confidence * 0.55 >= 0.02 GROUP BY 1)
        SELECT uid, round(max(score), 4) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM h2) GROUP BY 1""",
    "preflight_risk": f"""WITH {_EDGES}, d AS (SELECT a.path, count(DISTINCT b.path) AS dependants FROM calls JOIN n a ON a.uid = dst JOIN n b ON b.uid = src WHERE a.path <> b.path GROUP BY 1)
        SELECT path, dependants, CASE WHEN dependants >= 10 THEN 'HIGH' WHEN dependants >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d""",
    "canonical_dump": f"""WITH {_EDGES}, {_CO.strip()},
        e AS (SELECT src, dst, 'CALLS' AS kind, status, confidence FROM (
            SELECT src, dst, arg_min(status, (confidence, status)) AS status, max(confidence) AS confidence FROM (
              SELECT src, dst, 'CONFIRMED' AS status, CAST(0.5 AS DOUBLE) AS confidence FROM nest
              UNION ALL SELECT from_uid, r.uid, CASE WHEN confidence >= 0.9 THEN 'CONFIRMED' ELSE 'INFERRED' END, CAST(confidence AS DOUBLE) FROM resolved r WHERE from_uid IN (SELECT uid FROM n)) GROUP BY 1, 2)
          UNION ALL SELECT 'file:' || path_a, 'file:' || path_b, 'CO_CHANGES_WITH', 'OBSERVED', max(CAST(round(least(0.4 + 0.05 * support, 0.85), 4) AS DOUBLE)) FROM pairs
          WHERE 'file:' || path_a IN (SELECT uid FROM n) AND 'file:' || path_b IN (SELECT uid FROM n) GROUP BY 1, 2)
        SELECT concat_ws(chr(9), 'N', uid, kind, coalesce(name, ''), coalesce(path, ''), coalesce(CAST(line_start AS VARCHAR), ''), coalesce(CAST(line_end AS VARCHAR), ''), coalesce(lang, ''), coalesce(top_status, ''), printf('%.4f', top)) AS line FROM n JOIN st USING (uid)
        UNION ALL SELECT concat_ws(chr(9), 'E', src, dst, kind, status, printf('%.4f', confidence)) FROM e""",
    "impact_of_symbol": f"""WITH {_EDGES}, o AS (SELECT uid FROM n WHERE kind = 'Symbol' AND lower(name) LIKE 'release%'),
        d1 AS (SELECT DISTINCT src AS uid FROM calls WHERE dst IN (SELECT uid FROM o) AND src NOT IN (SELECT uid FROM o)),
        d2 AS (SELECT DISTINCT src AS uid FROM calls WHERE dst IN (SELECT uid FROM d1) AND src NOT IN (SELECT uid FROM o) AND src NOT IN (SELECT uid FROM d1)),
        r AS (SELECT uid, 0 AS distance FROM o UNION ALL SELECT uid, 1 FROM d1 UNION ALL SELECT uid, 2 FROM d2),
        best AS (SELECT src AS uid, max(confidence) AS c FROM calls WHERE dst IN (SELECT uid FROM r) GROUP BY 1)
        SELECT r.uid, distance, round(CAST(c AS DOUBLE), 4) AS confidence, 'calls' AS how FROM r JOIN best USING (uid) WHERE distance > 0 ORDER BY distance, c DESC, uid LIMIT 60""",
    "search_scripts": f"""WITH b AS (SELECT section_id, concat_ws(' ', max(title), max(body)) AS body FROM sections GROUP BY 1),
        t AS (SELECT section_id, regexp_extract_all(regexp_replace(translate(lower(body), '{ACCENTED}', '{PLAIN}'), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS t FROM b),
        sized AS (SELECT section_id, len(t) AS dl, t FROM t WHERE len(t) > 0), whole AS (SELECT count(*) AS n, avg(dl) AS a FROM sized),
        asked(q, wide) AS (VALUES ('phe', false), ('duyet', true), ('verkaufer', true), ('주문은', false), ('ลูกค้า', false), ('approval', true), ('apre', true)),
        tf AS (SELECT section_id, dl, q, len(list_filter(t, lambda x: CASE WHEN wide THEN starts_with(x, q) ELSE x = q END)) AS f FROM sized, asked),
        df AS (SELECT q, count(*) AS d FROM tf WHERE f > 0 GROUP BY 1)
        SELECT section_id, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score FROM tf JOIN df USING (q), whole WHERE f > 0 GROUP BY 1 ORDER BY score DESC, section_id LIMIT 60""",
    "co_change": f"WITH {_CO} SELECT repo, path_a, path_b, support, CAST(round(least(0.4 + 0.05 * support, 0.85), 4) AS DOUBLE) AS confidence FROM pairs",
    "term_prior": f"""WITH {_COMMITS}, st AS (SELECT sha, repo, files, list_transform({_meaningful('subject')}, lambda v: {_stem('v')}) AS t FROM c WHERE subject IS NOT NULL AND len(files) <= 20),
        e0 AS (SELECT repo, list_filter(t, lambda v, i: list_position(t, v) = i)[1:12] AS t, unnest(files) AS path FROM st),
        e AS (SELECT unnest(t) AS term, [path] AS files FROM e0 WHERE (repo, path) IN (SELECT repo, path FROM discovered WHERE path IS NOT NULL)),
        x AS (SELECT term, unnest(files) AS path FROM e), p AS (SELECT term, path, count(*) AS n FROM x GROUP BY 1, 2),
        s AS (SELECT term, path, n, ln(CAST(n AS DOUBLE) * sum(n) OVER () / (sum(n) OVER (PARTITION BY term) * sum(n) OVER (PARTITION BY path))) AS pmi FROM p),
        r AS (SELECT term, path, n, round(pmi * ln(1 + n), 4) AS score FROM s WHERE n >= 2 AND pmi > 0)
        SELECT term, path, n, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, path) AS k FROM r) WHERE k <= 40""",
    "prior_topk": f"""WITH {_COMMITS}, st AS (SELECT sha, repo, files, list_transform({_meaningful('subject')}, lambda v: {_stem('v')}) AS t FROM c WHERE subject IS NOT NULL AND len(files) <= 20),
        e0 AS (SELECT repo, list_filter(t, lambda v, i: list_position(t, v) = i)[1:12] AS t, unnest(files) AS path FROM st),
        e AS (SELECT unnest(t) AS term, [path] AS files FROM e0 WHERE (repo, path) IN (SELECT repo, path FROM discovered WHERE path IS NOT NULL)),
        x AS (SELECT term, unnest(files) AS path FROM e), p AS (SELECT term, path, count(*) AS n FROM x GROUP BY 1, 2),
        s AS (SELECT term, path, n, ln(CAST(n AS DOUBLE) * sum(n) OVER () / (sum(n) OVER (PARTITION BY term) * sum(n) OVER (PARTITION BY path))) AS pmi FROM p),
        r AS (SELECT term, path, n, round(pmi * ln(1 + n), 4) AS score FROM s WHERE n >= 2 AND pmi > 0),
        k AS (SELECT term, path, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, path) AS k FROM r) WHERE k <= 40)
        SELECT path, round(sum(score), 4) AS score FROM k WHERE term IN ('approval', 'discount', 'balance') GROUP BY path ORDER BY 2 DESC, path LIMIT 8""",
    "recent_per_file": f"""WITH {_COMMITS}, r AS (SELECT repo, path, sha, {_class("lower(trim(coalesce(subject, '')))")} AS k, row_number() OVER (PARTITION BY repo, path ORDER BY authored_ts DESC NULLS LAST, sha) AS rank FROM cf)
        SELECT repo, path, sha, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8 AND k IN ('fix', 'feature', 'refactor', 'revert', 'other')""",
    "introduced_by": f"WITH {_COMMITS} SELECT repo, path, arg_min(sha, (authored_ts, sha)) AS sha FROM cf GROUP BY 1, 2",
    "commits_by_file": f"WITH {_COMMITS} SELECT repo, path, count(*) AS n, max(authored_ts) AS newest FROM cf GROUP BY 1, 2",
    "ground_labels": f"""WITH {_NODES}, idx AS (SELECT DISTINCT uid, unnest(list_filter({_split('name')}, lambda w: strlen(w) >= 3 AND NOT list_contains({_STOP}, w))) AS word FROM n WHERE kind IN ('Symbol', 'DatabaseObject')),
        l AS (SELECT label, unnest(string_split(label, ' ')) AS word FROM (VALUES ('approve payment'), ('order status'), ('close period'), ('invoice total'), ('release stock'), ('match bank'), ('customer group')) v(label)),
        h AS (SELECT label, uid, count(*) AS got FROM l JOIN idx USING (word) GROUP BY 1, 2)
        SELECT label, uid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY uid) AS r FROM h WHERE got = 2) WHERE r <= 24""",
    "table_access": r"""WITH present AS (SELECT repo, path, arg_max(content, (mtime, content)) AS content, arg_max(lang, (mtime, content)) AS lang FROM discovered WHERE path IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT path, content FROM present WHERE lang = 'sql' AND content IS NOT NULL),
        w AS (SELECT DISTINCT path, lower(unnest(regexp_extract_all(content, '(?i)\b(?:insert\s+into|update|delete\s+from|create\s+table(?:\s+if\s+not\s+exists)?|alter\s+table|truncate\s+table)\s+([A-Za-z_][A-Za-z0-9_$]*)', 1))) AS "table" FROM f),
        r AS (SELECT DISTINCT path, lower(unnest(regexp_extract_all(content, '(?i)\b(?:from|join)\s+((?:[A-Za-z_][A-Za-z0-9_$]*\.)*[A-Za-z_][A-Za-z0-9_$]*)', 1))) AS "table" FROM f)
        SELECT path, "table", 'write' AS access FROM w WHERE "table" NOT IN (%s) AND strlen("table") >= 2 UNION ALL
        SELECT path, "table", 'read' FROM r WHERE "table" NOT IN (%s) AND strlen("table") >= 2 AND (path, "table") NOT IN (SELECT path, "table" FROM w)""" % ((", ".join(f"'{w}'" for w in lex.NOT_TABLES),) * 2),
    "repo_fingerprint": "WITH d AS (SELECT DISTINCT repo, path || ' ' || lower(hash) AS x FROM discovered WHERE hash IS NOT NULL AND path IS NOT NULL) SELECT repo, count(x) || ':' || CAST(sum(CAST('0x' || left(sha256(x), 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(sha256(x), 13, 12) AS BIGINT)) AS VARCHAR) AS fingerprint FROM d GROUP BY repo",
    "merge_regions": """WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - 3600 AS a, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS b FROM events),
        m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 7200 THEN 0 ELSE 1 END AS fresh FROM s),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
        SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS spans FROM i GROUP BY user_id, island""",
    "score_outcomes": f"WITH {_OUTCOMES} SELECT * FROM outcomes",
    "summary_mrr": f"""WITH {_OUTCOMES} SELECT condition, count(*) AS tasks, count(first_hit_rank) AS tasks_with_a_hit, round(count(first_hit_rank) / count(*), 4) AS hit_rate, round(avg(recall), 4) AS mean_recall,
        round(avg(precision), 4) AS mean_precision, round(avg(coalesce(1.0 / first_hit_rank, 0)), 4) AS mrr, {_MEDIAN.format('tokens_to_first_hit')} AS median_tokens_to_first_hit, {_MEDIAN.format('tokens_total')} AS median_tokens_total, {_MEDIAN.format('files')} AS median_files
        FROM outcomes GROUP BY condition""",
    "paired": f"""WITH {_OUTCOMES}, b AS (SELECT x.tokens_to_first_hit AS a, y.tokens_to_first_hit AS b FROM outcomes x JOIN outcomes y ON x.task = y.task AND x.condition = 'often' AND y.condition = 'named')
        SELECT count(*) AS tasks, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_hit, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_first, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_second,
               count(*) FILTER (a IS NULL AND b IS NULL) AS neither, round(avg(a - b), 4) AS mean_saving FROM b""",
    "losses": f"""WITH {_OUTCOMES}, b AS (SELECT x.task, x.tokens_to_first_hit AS base, y.tokens_to_first_hit AS own FROM outcomes x JOIN outcomes y ON x.task = y.task AND x.condition = 'named' AND y.condition = 'often' WHERE x.tokens_to_first_hit IS NOT NULL)
        SELECT task, CASE WHEN own IS NULL THEN 'missed' ELSE 'dearer' END AS loss, base, own FROM b WHERE own IS NULL OR base < own""",
    "expected_tokens": f"WITH {_OUTCOMES} SELECT condition, round(avg(coalesce(tokens_to_first_hit, 4000)), 4) AS expected_tokens FROM outcomes GROUP BY condition",
    "hit_interval": f"""WITH {_OUTCOMES}, g AS (SELECT condition, CAST(count(*) AS DOUBLE) AS n, count(first_hit_rank) / count(*) AS p FROM outcomes GROUP BY 1)
        SELECT condition, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 4) AS low,
               round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 4) AS high FROM g""",
    "event_stream": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "report_scorecard": f"""WITH {_EDGES}, {_CO.split('pairs AS', 1)[0].strip().rstrip(',')}, pairs AS {_CO.split('pairs AS', 1)[1]},
        ce AS (SELECT 1 FROM pairs WHERE 'file:' || path_a IN (SELECT uid FROM n) AND 'file:' || path_b IN (SELECT uid FROM n))
        SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'Symbol') AS symbols, 0 AS sections, 0 AS concepts, 0 AS tables, 0 AS rules, 0 AS commits, CAST(0 AS DOUBLE) AS documented_share,
               (SELECT count(*) FROM calls) + (SELECT count(*) FROM ce) AS edges FROM n""",
    "code_phrases": f"""WITH {_NODES}, w AS (SELECT uid, {_split('name')} AS w FROM n WHERE kind = 'Symbol'), lim AS (SELECT greatest(count(*) * 0.5, 25) AS l FROM w),
        common AS (SELECT word FROM (SELECT uid, unnest(list_distinct(w)) AS word FROM w) GROUP BY word HAVING count(*) > (SELECT l FROM lim)),
        p AS (SELECT DISTINCT uid, w[i] AS a, w[i + 1] AS b FROM w, range(1, 30) t(i) WHERE i < len(w))
        SELECT a || ' ' || b AS phrase, count(DISTINCT uid) AS symbols FROM p WHERE length(a) >= 3 AND length(b) >= 3 AND a NOT IN (SELECT word FROM common) AND b NOT IN (SELECT word FROM common)
        GROUP BY 1 HAVING count(DISTINCT uid) >= 3 ORDER BY symbols DESC, phrase LIMIT 400""",
    "heading_concepts": f"""WITH {_NODES}, idx AS (SELECT DISTINCT uid, unnest(list_filter({_split('name')}, lambda w: strlen(w) >= 3 AND NOT list_contains({_STOP}, w))) AS word FROM n WHERE kind IN ('Symbol', 'DatabaseObject')),
        h AS (SELECT DISTINCT replace(regexp_extract(slug, '[^.]*$'), '-', ' ') AS label FROM sections WHERE slug IS NOT NULL),
        l AS (SELECT label, unnest({_meaningful('label')}) AS word FROM h), need AS (SELECT label, count(*) AS need FROM l GROUP BY 1),
        hit AS (SELECT label, uid FROM l JOIN idx USING (word) JOIN need USING (label) GROUP BY label, uid, need HAVING count(*) = need),
        g AS (SELECT label, least(count(*), 24) AS grounded, trim(regexp_replace(upper(label), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS concept FROM hit GROUP BY label)
        SELECT concept, min(label) AS label, CAST(max(grounded) AS BIGINT) AS grounded FROM g GROUP BY concept ORDER BY grounded DESC, concept LIMIT 400""",
    "coverage_by_language": f"""WITH {_EDGES}, {_CO.strip()},
        e AS (SELECT src, dst FROM calls UNION SELECT 'file:' || path_a, 'file:' || path_b FROM pairs),
        entered AS (SELECT DISTINCT b.path FROM e JOIN n a ON a.uid = e.src JOIN n b ON b.uid = e.dst WHERE a.path <> b.path),
        f AS (SELECT path, max(lang) AS lang FROM n WHERE kind = 'File' AND path IS NOT NULL GROUP BY path),
        g AS (SELECT lang, count(*) AS files, count(*) FILTER (path IN (SELECT path FROM entered)) AS covered FROM f GROUP BY lang)
        SELECT lang, files, covered, round(covered / files, 4) AS share FROM g
        UNION ALL SELECT 'TOTAL', CAST(sum(files) AS BIGINT), CAST(sum(covered) AS BIGINT), round(sum(covered) / sum(files), 4) FROM g""",
    "tasks_from_history": f"""WITH {_COMMITS}, k AS (SELECT *, {_class('lower(trim(subject))')} AS kind,
          trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(subject), '^[A-Za-z]+(\\([^()]*\\))?!?: *', ''), '\\([^()]*\\)', ' ', 'g'), '#[0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS prompt FROM c WHERE subject IS NOT NULL),
        x AS (SELECT sha, repo, prompt, unnest(files) AS path FROM k WHERE kind IN ('fix', 'feature') AND len(string_split(prompt, ' ')) >= 5
          AND NOT regexp_matches(lower(subject), 'bump|version|translation|typo|lint|format|changelog|merge|revert|pre-commit|ci:|chore|whitespace|rename')),
        code AS (SELECT * FROM x WHERE {_extension()} IN ({', '.join(repr(c) for c in lex.CODE_LANGUAGES)})),
        kept AS (SELECT sha FROM code GROUP BY sha HAVING count(*) BETWEEN 1 AND 6 AND NOT bool_or({_TEST}))
        SELECT sha AS task, repo, prompt, path FROM code WHERE sha IN (SELECT sha FROM kept) AND (repo, path) IN (SELECT repo, path FROM discovered)""",
}
ORACLES["stored_bm25"] = ORACLES["bm25_topk"]
