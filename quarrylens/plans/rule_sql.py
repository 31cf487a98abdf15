"""SQL that mines the same rules as ``operators.rules`` from the tables, for the check against DuckDB."""

from __future__ import annotations

from quarrylens.functions import lexicon as lex
from quarrylens.plans.oracles import _NODES, _TEST, _meaningful, _split, _stem

_EDGE_BEFORE, _EDGE_AFTER = "(?:^|[^\\p{L}\\p{M}\\p{N}_])", "(?:$|[^\\p{L}\\p{M}\\p{N}_])"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sentences(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?;\\n•]'), lambda p: {squeeze('p')}), lambda p: p <> '')"


def checkable(claim: str) -> str:
    words = f"len(string_split({squeeze(claim)}, ' '))"
    return f"(length({claim}) <= 220 AND CASE WHEN {words} > 1 THEN {words} ELSE length({claim}) // 6 END BETWEEN 4 AND 40)"


def modal(text: str) -> str:
    return f"regexp_matches({text}, {_quoted(f'(?i){_EDGE_BEFORE}(?:{lex.MODAL_WORDS}){_EDGE_AFTER}|(?:{lex.MODAL_PARTS})')})"


def humanise(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(replace({text}, '_', ' '), '\\s+'), lambda h: h <> '')"
    mixed = "regexp_matches(h, '\\p{Lu}') AND regexp_matches(h, '\\p{Ll}')"
    each = f"CASE WHEN {mixed} THEN {_split('h')} ELSE [regexp_replace(h, '^[:()]+|[:()]+$', '', 'g')] END"
    return f"array_to_string(list_filter(flatten(list_transform({words}, lambda h: {each})), lambda h: h <> ''), ' ')"


def _says(text: str, words: list[str]) -> str:
    whole = [w for w in words if w.isascii() and " " not in w]
    parts = [w for w in words if w not in whole]
    found = [f"regexp_matches({text}, {_quoted(f'{_EDGE_BEFORE}(?:' + '|'.join(whole) + f'){_EDGE_AFTER}')})"] if whole else []
    return "(" + " OR ".join(found + [f"contains({text}, {_quoted(p)})" for p in parts]) + ")"


def said(text: str) -> str:
    """``subject|polarity`` of a phrase, or null."""
    cases = []
    for name, (terms, require, bypass) in lex.SUBJECTS.items():
        about = "(" + " OR ".join(f"contains({text}, {_quoted(t)})" for t in terms.split("|")) + ")"
        for polarity, words in (("bypass", bypass.split() + lex.BYPASS_WORDS), ("require", require.split() + lex.REQUIRE_WORDS)):
            cases.append(f"WHEN {about} AND {_says(text, words)} THEN '{name}|{polarity}'")
    return f"CASE {' '.join(cases)} END"


def _own_words() -> str:
    cases = []
    for name, (terms, _, _) in lex.SUBJECTS.items():
        words = sorted({w for t in terms.split("|") for w in t.split()})
        cases.append(f"WHEN '{name}' THEN [{', '.join(map(_quoted, words))}]")
    return f"CASE subject {' '.join(cases)} END"


_STRENGTH = "CASE source " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in lex.RULE_STRENGTH.items()) + " END"
_SPEC = "NOT (" + " OR ".join(f"contains(lower(path), '{m}')" for m in lex.HISTORICAL_MARKS) + ")"

RULES = f"""{_NODES},
present AS (SELECT repo, path, arg_max(content, (mtime, content)) AS content FROM discovered WHERE path IS NOT NULL GROUP BY 1, 2),
section_rows AS (SELECT section_id, path, line_no, body, row_number() OVER (PARTITION BY section_id ORDER BY body DESC, path DESC, line_no DESC) AS rn FROM sections WHERE body IS NOT NULL),
doc_claims AS (
  SELECT unnest({sentences('body')}) AS claim, 'doc:' || section_id AS anchor,
         CASE WHEN path IS NOT NULL AND line_no > 0 THEN path || ':' || line_no ELSE coalesce(path, 'doc:' || section_id) END AS location
  FROM section_rows WHERE rn = 1 AND path IS NOT NULL AND {_SPEC}),
told AS (SELECT location AS place, documentation, row_number() OVER (PARTITION BY location ORDER BY documentation DESC) AS rn FROM why_answers WHERE location IS NOT NULL AND documentation IS NOT NULL),
told_claims AS (SELECT unnest({sentences('documentation')}) AS claim, 'at:' || place AS anchor, 'code' AS location FROM told WHERE rn = 1),
bodies AS (
  SELECT n.uid, coalesce(n.name, '') AS name, n.path, n.line_start,
         string_split(content, chr(10))[n.line_start:n.line_end] AS l
  FROM n JOIN present p ON p.path = n.path WHERE n.kind = 'Symbol' AND n.line_start > 0 AND n.line_end >= n.line_start AND content IS NOT NULL),
test_claims AS (
  SELECT {humanise("regexp_replace(name, '^[Tt]est_?', '')")} AS claim, uid AS anchor, path || ':' || line_start AS location
  FROM bodies WHERE {_TEST} AND starts_with(lower(name), 'test')),
guard_lines AS (SELECT uid, path, line_start, l, unnest(generate_series(1, len(l))) AS i FROM bodies),
guard_claims AS (
  SELECT {humanise("array_to_string(l[i:i + 3], ' ')")} AS claim, uid AS anchor, path || ':' || (line_start + i - 1) AS location
  FROM guard_lines WHERE regexp_matches(trim(l[i]), '^(if|elif|else if|unless|when)\\b')),
candidates AS (
  SELECT 'document' AS source, * FROM doc_claims WHERE {checkable('claim')} AND {modal('claim')}
  UNION ALL SELECT 'code_doc', * FROM told_claims WHERE {checkable('claim')} AND {modal('claim')}
  UNION ALL SELECT 'test', * FROM test_claims WHERE {checkable('claim')}
  UNION ALL SELECT 'code_guard', * FROM guard_claims),
judged AS (SELECT *, {said('lower(claim)')} AS said FROM candidates),
placed AS (SELECT source, claim, anchor, location, string_split(said, '|')[1] AS subject, string_split(said, '|')[2] AS polarity FROM judged WHERE said IS NOT NULL),
single AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, polarity, source, anchor ORDER BY length(claim), claim, location) AS k FROM placed) WHERE k = 1),
kinds AS (SELECT subject, polarity, count(DISTINCT source) - 1 AS others FROM single GROUP BY 1, 2),
rules AS (
  SELECT 'rule:' || left(sha256(subject || '|' || polarity || '|' || {squeeze('lower(claim)')}), 10) AS rule, subject, polarity, source, claim, anchor, location, CAST(others AS INTEGER) AS corroborated,
         CASE WHEN others > 0 THEN round(least({_STRENGTH} * (1 + 0.15::DOUBLE * others), 0.97), 4) ELSE {_STRENGTH} END AS confidence,
         CASE WHEN others >= 2 THEN 'OBSERVED' ELSE 'INFERRED' END AS status
  FROM single JOIN kinds USING (subject, polarity)),
stems AS (
  SELECT DISTINCT rule, subject, polarity, source, claim, stem FROM (
    SELECT *, unnest(list_transform(list_filter({_meaningful('claim')}, lambda w: NOT list_contains({_own_words()}, w)), lambda w: {_stem('w')})) AS stem
    FROM rules WHERE confidence >= 0.7)),
conflicts AS (
  SELECT a.rule AS documented, b.rule AS observed, a.subject, a.claim AS documented_claim, b.claim AS observed_claim, count(DISTINCT a.stem) AS shared
  FROM stems a JOIN stems b ON a.subject = b.subject AND a.stem = b.stem AND a.polarity <> b.polarity
  WHERE a.source = 'document' AND b.source <> 'document' GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT a.stem) >= 2)"""

RULE_ORACLES = {
    "mined_rules": f"WITH {RULES} SELECT source, subject, polarity, count(*) AS rules, round(max(confidence), 4) AS confidence FROM rules GROUP BY 1, 2, 3",
    "rule_conflicts": f"WITH {RULES} SELECT documented_claim, observed_claim, subject, shared FROM conflicts",
    "corroborate": f"WITH {RULES} SELECT claim, corroborated, confidence, status FROM rules",
    "rule_listing": f"WITH {RULES} SELECT rule, subject, polarity, source, anchor, location, confidence FROM rules WHERE confidence >= 0.7",
    "rule_nodes": f"""WITH {RULES} SELECT uid, left(claim, 80) AS name FROM (
        SELECT DISTINCT rule AS uid, first_value(claim) OVER (PARTITION BY rule ORDER BY claim) AS claim FROM rules
        UNION SELECT DISTINCT 'conflict:' || left(sha256(documented || '|' || observed), 8), first_value(documented_claim) OVER (PARTITION BY documented, observed ORDER BY documented_claim) FROM conflicts)""",
    "rule_edges": f"""WITH {RULES}, k AS (SELECT DISTINCT 'conflict:' || left(sha256(documented || '|' || observed), 8) AS src, unnest([documented, observed]) AS rule FROM conflicts)
        SELECT src, dst, kind, count(*) AS n FROM (
          SELECT DISTINCT anchor AS src, rule AS dst, 'IMPLEMENTS_RULE' AS kind FROM rules UNION ALL SELECT DISTINCT src, anchor, 'CONTRADICTS' FROM k JOIN rules USING (rule)) GROUP BY 1, 2, 3""",
    "rule_evidence": f"WITH {RULES} SELECT DISTINCT rule AS uid, source, location AS locator FROM rules",
    "claim_sentences": f"""SELECT section_id, len(s) AS sentences, len(list_filter(s, lambda c: {checkable('c')})) AS checkable, len(list_filter(s, lambda c: {modal('c')})) AS modal
        FROM (SELECT section_id, {sentences('body')} AS s FROM (SELECT section_id, max(body) AS body FROM sections WHERE body IS NOT NULL GROUP BY 1))""",
    "phrase_subjects": f"SELECT said, count(*) AS sentences FROM (SELECT {said('lower(c)')} AS said FROM (SELECT unnest({sentences('body')}) AS c FROM sections WHERE body IS NOT NULL)) WHERE said IS NOT NULL GROUP BY 1",
    "human_names": f"SELECT name, {humanise('name')} AS words FROM (SELECT DISTINCT name FROM nodes WHERE name IS NOT NULL)",
}
