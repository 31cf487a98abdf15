"""Queries that run single functions and operators over whole tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import concepts, evaluate, extract, graph, history, ranking, resolve
from quarrylens.plans import tables
from quarrylens.plans.oracles import _CO, _COMMITS, _EDGES, _NODES, _OUTCOMES, _STOP, ORACLES, _class, _extension, _meaningful, _split, _stem
from quarrylens.plans.rule_sql import squeeze
from quarrylens.runtime import cut, pick, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name together with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


# -- text ------------------------------------------------------------------------------


@query("SELECT strftime(make_timestamp(authored_ts * 1000000), '%Y-%m-%d') AS day, count(*) AS deliveries FROM commits WHERE authored_ts IS NOT NULL GROUP BY 1")
def commit_dates(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "commits"), "authored_ts").where("authored_ts is not null")
    return rows.groupBy(T.utc_date("authored_ts").alias("day")).agg(F.count(F.lit(1)).alias("deliveries"))


@query(f"SELECT section_id, left({squeeze('body')}, 280) AS excerpt FROM (SELECT section_id, max(body) AS body FROM sections WHERE body IS NOT NULL GROUP BY 1)")
def section_excerpts(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "sections"), "section_id", "body").where("body is not null")
    return rows.groupBy("section_id").agg(F.max("body").alias("body")).select("section_id", T.excerpt("body").alias("excerpt"))


@query(f"""SELECT DISTINCT answer_id, left(trim(split_part(signature, chr(10), 1)), 160) AS signature,
    left({squeeze("regexp_replace(regexp_replace(documentation, '^[rbfu]+([\"''])', '\\1'), '^[\"'']+|[\"'']+$', '', 'g')")}, 400) AS documentation
    FROM why_answers WHERE signature IS NOT NULL AND documentation IS NOT NULL""")
def answer_texts(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "why_answers"), "answer_id", "signature", "documentation").where("signature is not null and documentation is not null")
    return rows.select("answer_id", T.signature_line("signature").alias("signature"), T.docstring("documentation").alias("documentation")).distinct()


_TASK_WORDS = "list_filter(regexp_split_to_array(subject, '[^\\p{L}\\p{N}_.]+'), lambda w: w <> '')"
_TASK_PARTS = f"flatten(list_transform({_TASK_WORDS}, lambda w: list_concat([regexp_replace(w, '^\\.+|\\.+$', '', 'g')], string_split(w, '.'))))"


@query(f"""SELECT subject, array_to_string(list_sort(list_distinct(list_filter({_TASK_PARTS}, lambda w: length(w) >= 4 AND (contains(w, '_') OR regexp_matches(substr(w, 2), '\\p{{Lu}}'))))), ' ') AS identifiers
    FROM (SELECT DISTINCT subject FROM commits WHERE subject IS NOT NULL)""")
def task_identifiers(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "commits"), "subject").where("subject is not null").distinct()
    return rows.select("subject", F.array_join(T.identifier_tokens("subject"), " ").alias("identifiers"))


def _stems(words: str) -> str:
    return f"list_distinct(list_transform({words}, lambda v: {_stem('v')}))"


@query(f"""WITH {_COMMITS}, w AS (SELECT sha, path, {_stems(_meaningful('subject'))} AS a, {_stems(_meaningful("replace(path, '/', ' ')"))} AS p FROM cf WHERE subject IS NOT NULL)
    SELECT sha, path, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, p)) / len(a), 4) END AS affinity FROM w""")
def subject_affinity(s: SparkSession, d: str) -> DataFrame:
    """How many words of a commit's subject the paths it changed hold."""
    rows = history.commits(table(s, d, "commits")).where("subject is not null").select("sha", T.meaningful_words("subject").alias("asked"), F.explode("files").alias("path"))
    return rows.where("path is not null").select("sha", "path", F.round(T.path_affinity(F.col("asked"), "path"), 4).alias("affinity"))


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[\\s\\x0B,]+'), lambda x: regexp_replace(x, '^[`''"*\\-(\\[]+|[`''"*)\\],.:;]+$', '', 'g')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT doc_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[\\w./\\-]+\\.[A-Za-z0-9]+$') AND NOT contains(x, '..')))), ' ') AS paths FROM w""")
def reply_paths(s: SparkSession, d: str) -> DataFrame:
    rows = pick(table(s, d, "documents"), "doc_id", "text").where("text is not null")
    return rows.select("doc_id", F.array_join(F.array_sort(T.parse_paths("text", 1 << 30)), " ").alias("paths")).distinct()


def _bare(text: str) -> str:
    return f"""regexp_replace({text}, '^["'']+|["'']+$', '', 'g')"""


_FIRST = "regexp_extract({0}, '^\\s*(\\S+)', 1)"


@query(f"""WITH l AS (SELECT DISTINCT regexp_replace(unnest(string_split(content, chr(10))), '\\r+$', '') AS line FROM discovered WHERE content IS NOT NULL),
    i AS (SELECT line, CASE WHEN starts_with(line, 'from ') THEN [{_bare(_FIRST.format("substr(line, 6)"))}]
      ELSE list_transform(string_split(substr(line, 8), ','), lambda p: CASE WHEN {_FIRST.format('p')} = '{{' THEN '' ELSE {_bare(_FIRST.format('p'))} END) END AS m,
      regexp_replace(trim(regexp_extract(line, '^.*? from (.*)$', 1)), '^["'';]+|["'';]+$', '', 'g') AS tail FROM l WHERE regexp_matches(line, '^(from|import) '))
    SELECT line, array_to_string(list_sort(list_distinct(list_filter(list_concat(m, [tail]), lambda x: x <> ''))), ' ') AS modules FROM i""")
def imported_modules(s: SparkSession, d: str) -> DataFrame:
    lines = pick(table(s, d, "discovered"), "content").where("content is not null").select(F.explode(F.split("content", "\n")).alias("line"))
    lines = lines.select(F.regexp_replace("line", r"\r+$", "").alias("line")).where(F.col("line").rlike("^(from|import) ")).distinct()
    return lines.select("line", F.array_join(T.import_modules("line"), " ").alias("modules"))


@query(f"""WITH {_NODES} SELECT uid, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.summary') END AS summary, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.signature') END AS signature FROM n""")
def payload_fields(s: SparkSession, d: str) -> DataFrame:
    return tables.nodes(s, d).select("uid", F.get_json_object("payload", "$.summary").alias("summary"), F.get_json_object("payload", "$.signature").alias("signature"))


_PREVIEW = "concat_ws(' ', kind, name, path, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.summary') END, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.claim') END)"


@query(f"""WITH {_NODES}, p AS (SELECT uid, {_PREVIEW} AS t FROM n),
    w AS (SELECT uid, t, regexp_replace(t, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g') AS narrow FROM p)
    SELECT uid, CAST(CASE WHEN t = '' THEN 0 ELSE greatest(1, ceil(strlen(narrow) / 4.0) + ceil((length(t) - length(narrow)) / 1.5)) END AS BIGINT) AS tokens FROM w""")
def node_costs(s: SparkSession, d: str) -> DataFrame:
    return tables.nodes(s, d).select("uid", "tokens")


@query(f"WITH {_NODES} SELECT uid, CASE WHEN path IS NOT NULL AND line_start > 0 THEN path || ':' || line_start ELSE coalesce(path, uid) END AS place FROM n")
def node_places(s: SparkSession, d: str) -> DataFrame:
    return tables.nodes(s, d).select("uid", T.location(F.col("path"), F.col("line_start"), F.col("uid")).alias("place"))


@query("SELECT DISTINCT target, regexp_extract(target, '^(.*):(\\d+)$', 1) AS path, TRY_CAST(regexp_extract(target, '^(.*):(\\d+)$', 2) AS INTEGER) AS line FROM why_answers WHERE target IS NOT NULL")
def asked_targets(s: SparkSession, d: str) -> DataFrame:
    """Targets as a place in a file; without one the path is empty and the line null."""
    rows = pick(table(s, d, "why_answers"), "target").where("target is not null").distinct()
    part = lambda k: F.regexp_extract("target", r"^(.*):(\d+)$", k)
    return rows.select("target", part(1).alias("path"), part(2).try_cast("int").alias("line"))


@query(f"WITH {_COMMITS}, x AS (SELECT repo, {_class('lower(trim(subject))')} AS kind FROM c WHERE subject IS NOT NULL) SELECT repo, kind AS change_class, count(*) AS commits FROM x GROUP BY 1, 2")
def commit_classes(s: SparkSession, d: str) -> DataFrame:
    return history.commits(table(s, d, "commits")).where("subject is not null").groupBy("repo", "change_class").agg(F.count(F.lit(1)).alias("commits"))


# -- filters over the graph --------------------------------------------------------------


@query(f"WITH {_NODES} SELECT uid, name, path FROM n WHERE kind = 'File'")
def files_by_name(s: SparkSession, d: str) -> DataFrame:
    return graph.nodes_of_kind(tables.nodes(s, d), "File").select("uid", "name", "path")


@query(f"""WITH {_NODES}, k AS (SELECT path, count(*) AS c FROM n WHERE kind = 'Symbol' AND path IS NOT NULL GROUP BY 1 ORDER BY c DESC, path LIMIT 1)
    SELECT uid, name, line_start FROM n WHERE kind = 'Symbol' AND path = (SELECT path FROM k)""")
def symbols_of_a_file(s: SparkSession, d: str) -> DataFrame:
    """The symbols of the file that has most of them."""
    n = tables.nodes(s, d)
    most = n.where("kind = 'Symbol' and path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "path").first()
    return graph.symbols_in(n, most.path if most else "").select("uid", "name", "line_start")


@query(f"""WITH {_NODES}, k AS (SELECT name, count(*) AS c FROM n WHERE kind = 'Symbol' AND name IS NOT NULL GROUP BY 1 ORDER BY c DESC, name LIMIT 1)
    SELECT uid FROM n WHERE kind = 'Symbol' AND name = (SELECT name FROM k) ORDER BY uid LIMIT 64""")
def symbols_of_a_name(s: SparkSession, d: str) -> DataFrame:
    n = tables.nodes(s, d)
    most = n.where("kind = 'Symbol' and name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "name").first()
    return graph.symbols_named(n, most.name if most else "").select("uid")


@query(f"WITH {_NODES} SELECT DISTINCT name FROM n WHERE kind = 'Symbol' AND path IN (SELECT unnest(files) FROM commits)")
def names_in_changed_files(s: SparkSession, d: str) -> DataFrame:
    paths = pick(table(s, d, "commits"), "files").select(F.explode("files").alias("path")).distinct()
    return graph.distinct_names(tables.nodes(s, d), paths)


_RELEASE = "SELECT DISTINCT name FROM n WHERE kind = 'Symbol' AND lower(name) LIKE 'release%'"


@query(f"""WITH {_EDGES}, asked AS ({_RELEASE}), few AS (SELECT count(*) <= 400 AS ok FROM asked)
    SELECT DISTINCT from_uid, name FROM used, few WHERE NOT ok OR name IN (SELECT name FROM asked) OR path IN (SELECT path FROM n WHERE kind = 'Symbol' AND lower(name) LIKE 'release%')""")
def touched_references(s: SparkSession, d: str) -> DataFrame:
    """References that an edit of the symbols that release something can move."""
    symbols = tables.nodes(s, d).where("kind = 'Symbol' and lower(name) like 'release%'")
    refs = cut(tables.call_references(s, d))
    return resolve.touched_references(refs, symbols.select("name").distinct(), symbols.select("path").distinct()).select("from_uid", "name").distinct()


@query(f"WITH {_EDGES} SELECT DISTINCT from_uid, name FROM used WHERE from_uid IN (SELECT uid FROM n)")
def known_references(s: SparkSession, d: str) -> DataFrame:
    return resolve.known_references(tables.call_references(s, d), tables.nodes(s, d)).select("from_uid", "name").distinct()


@query(f"""WITH {_NODES}, {_CO.strip()}, e AS (SELECT 'file:' || path_a AS src, 'file:' || path_b AS dst FROM pairs)
    SELECT count(*) AS edges FROM e WHERE src NOT IN (SELECT uid FROM n) OR dst NOT IN (SELECT uid FROM n)""")
def unresolved_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs changed together of which a file is no node."""
    staged = history.co_changes(table(s, d, "commits")).select(F.concat(F.lit("file:"), "path_a").alias("src"), F.concat(F.lit("file:"), "path_b").alias("dst"))
    return graph.unresolved_edges(staged, tables.nodes(s, d)).agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {_CO}, k AS (SELECT path_a AS path FROM pairs ORDER BY support DESC, path_a, path_b LIMIT 1)
    SELECT path_b AS path, support FROM pairs WHERE path_a = (SELECT path FROM k) UNION ALL SELECT path_a, support FROM pairs WHERE path_b = (SELECT path FROM k)""")
def partners(s: SparkSession, d: str) -> DataFrame:
    """Partners of the file with the strongest pair, whichever side it is stored on."""
    pairs = cut(history.co_changes(table(s, d, "commits")))
    best = pairs.orderBy(F.desc("support"), "path_a", "path_b").first()
    return history.co_changed_with(pairs, best.path_a if best else "")


@query(f"""WITH a AS (SELECT DISTINCT path, "table" FROM ({ORACLES['table_access']})), u AS (SELECT "table", count(*) AS c FROM a GROUP BY 1 ORDER BY c DESC, "table" LIMIT 1), o AS (SELECT min(path) AS path FROM a WHERE "table" = (SELECT "table" FROM u)), t AS (SELECT "table" FROM a WHERE path = (SELECT path FROM o))
    SELECT 'file:' || path AS uid, min('db:' || "table") AS through FROM a WHERE "table" IN (SELECT "table" FROM t) AND path <> (SELECT path FROM o) GROUP BY 1""")
def coupled_files(s: SparkSession, d: str) -> DataFrame:
    """Files that read or write a table which the first file with the most used table reads or writes."""
    access = cut(extract.table_access(tables.files(s, d).where("lang = 'sql'")).select("path", "table", "access").distinct())
    e = access.select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("db:"), "table").alias("dst"), F.when(F.col("access") == "write", "WRITES").otherwise("READS").alias("kind"))
    most = access.select("path", "table").distinct().groupBy("table").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "table").limit(1)
    origin = access.join(F.broadcast(most.select("table")), "table").agg(F.concat(F.lit("file:"), F.min("path")).alias("uid"))
    return graph.data_coupled(e, origin)


@query(f"""WITH {_NODES}, sp AS (SELECT uid, path, line_start, line_end FROM n WHERE kind = 'Symbol' AND path IS NOT NULL AND line_start > 0 AND line_end >= line_start),
    l AS (SELECT *, unnest(generate_series(line_start, line_end)) AS line FROM sp), r AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY line_end - line_start, uid) AS k FROM l)
    SELECT uid, count(*) AS lines FROM r WHERE k = 1 GROUP BY 1""")
def own_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of each symbol that lie in no symbol inside it."""
    spans = tables.nodes(s, d).where("kind = 'Symbol' and path is not null and line_start > 0 and line_end >= line_start")
    return extract.without_nested(spans).groupBy("uid").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT DISTINCT 'file:' || path AS uid, regexp_extract(path, '[^/]*$') AS name, translate(path, '/_-.', '    ') AS search_text FROM discovered WHERE path IS NOT NULL")
def file_search_texts(s: SparkSession, d: str) -> DataFrame:
    return extract.file_nodes(tables.files(s, d)).select("uid", "name", "search_text").distinct()


# -- concepts ----------------------------------------------------------------------------


@query("""WITH t AS (SELECT CASE WHEN lang = 'en' THEN NULL ELSE lang END AS locale, regexp_extract(slug, '[^.]*$') AS key, max(title) AS value FROM sections WHERE title IS NOT NULL AND slug IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)
    SELECT 'titles' AS base, b.locale, a.key, a.value AS source, b.value AS target FROM t a JOIN t b ON a.key = b.key WHERE a.locale IS NULL AND b.locale IS NOT NULL AND a.value <> b.value""")
def bundle_pairs(s: SparkSession, d: str) -> DataFrame:
    """Titles of sections as messages of a bundle: English ones as the source, one of each other label as its translation."""
    rows = pick(table(s, d, "sections"), "lang", "slug", "title").where("title is not null and slug is not null and lang is not null")
    rows = rows.groupBy(F.nullif("lang", F.lit("en")).alias("locale"), F.substring_index("slug", ".", -1).alias("key")).agg(F.max("title").alias("value"))
    return concepts.join_bundles(rows.withColumn("base", F.lit("titles")))


_INDEX = f"""{_NODES}, idx AS (SELECT DISTINCT uid, unnest(list_filter({_split('name')}, lambda w: strlen(w) >= 3 AND NOT list_contains({_STOP}, w))) AS word FROM n WHERE kind IN ('Symbol', 'DatabaseObject'))"""
_TAIL = "replace(regexp_extract(slug, '[^.]*$'), '-', ' ')"


def _tails(s: SparkSession, d: str) -> DataFrame:
    return pick(table(s, d, "sections"), "slug").where("slug is not null").select(F.translate(F.substring_index("slug", ".", -1), "-", " ").alias("label")).distinct()


@query(f"""WITH {_INDEX}, h AS (SELECT DISTINCT {_TAIL} AS label FROM sections WHERE slug IS NOT NULL),
    l AS (SELECT DISTINCT label, unnest({_meaningful('label')}) AS word FROM h), k AS (SELECT * FROM l WHERE word IN (SELECT word FROM idx)),
    need AS (SELECT label, count(*) AS need FROM k GROUP BY 1),
    hit AS (SELECT label, uid FROM k JOIN idx USING (word) JOIN need USING (label) GROUP BY label, uid, need HAVING count(*) = need)
    SELECT label, uid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY uid) AS r FROM hit) WHERE r <= 24""")
def ground_relaxed(s: SparkSession, d: str) -> DataFrame:
    """Names that hold all words of a heading that any name has."""
    labels = _tails(s, d).select("label", T.meaningful_words("label").alias("words")).where(F.size("words") > 0)
    return concepts.ground(labels, cut(concepts.grounding_index(tables.nodes(s, d))), relaxed=True)


@query(f"""WITH {_INDEX}, t AS (SELECT section_id, {_TAIL} AS source, max(title) AS target FROM sections WHERE slug IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, {_meaningful('source')} AS words FROM t), able AS (SELECT * FROM w WHERE len(list_filter(words, lambda x: strlen(x) >= 4)) > 0),
    l AS (SELECT DISTINCT source, unnest(words) AS word FROM able), need AS (SELECT source, count(*) AS need FROM l GROUP BY 1),
    hit AS (SELECT DISTINCT source FROM (SELECT source, uid FROM l JOIN idx USING (word) JOIN need USING (source) GROUP BY source, uid, need HAVING count(*) = need)),
    k AS (SELECT regexp_replace(upper(source), '[^\\p{{L}}\\p{{N}}]+', '_', 'g') AS concept, section_id, source, target FROM able WHERE source IN (SELECT source FROM hit))
    SELECT concept, source, target FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY section_id DESC) AS r FROM k) WHERE r = 1""")
def translated_concepts(s: SparkSession, d: str) -> DataFrame:
    """Concepts of headings whose slug says one thing and whose title another; the last section of an id holds."""
    rows = pick(table(s, d, "sections"), "section_id", "slug", "title").where("slug is not null and title is not null")
    rows = rows.groupBy(F.col("section_id").alias("ord"), F.translate(F.substring_index("slug", ".", -1), "-", " ").alias("source")).agg(F.max("title").alias("target"))
    made = concepts.translation_concepts(cut(rows), cut(concepts.grounding_index(tables.nodes(s, d))), "other")
    return made.select("concept", F.col("labels")["eng"].alias("source"), F.col("labels")["other"].alias("target"))


def _staged_concepts(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    n = tables.nodes(s, d)
    heads = concepts.heading_concepts(_tails(s, d).withColumnRenamed("label", "title"), cut(concepts.grounding_index(n)))
    heads = heads.select(F.lit(1).alias("ord"), "concept", F.lit("eng").alias("lang"), "label", none.alias("code"), none.alias("tables"), F.lit("co-occurrence").alias("bridge"), F.lit("INFERRED").alias("status"), F.lit(0.6).alias("confidence"))
    phrases = concepts.code_phrases(n.where("kind = 'Symbol'"), share=0.5)
    phrases = phrases.select(F.lit(2).alias("ord"), T.normalize_id("phrase").alias("concept"), F.lit("eng").alias("lang"), F.col("phrase").alias("label"), none.alias("code"), none.alias("tables"), F.lit("code-vocabulary").alias("bridge"), F.lit("INFERRED").alias("status"), F.lit(0.5).alias("confidence"))
    return heads.unionByName(phrases)


_CONCEPTS = f"""hc AS (SELECT concept, label, 1 AS ord FROM ({ORACLES['heading_concepts']})),
    cp AS (SELECT regexp_replace(upper(phrase), '[^\\p{{L}}\\p{{N}}]+', '_', 'g') AS concept, phrase AS label, 2 AS ord FROM ({ORACLES['code_phrases']})),
    merged AS (SELECT concept, arg_min(label, ord) AS label, CASE WHEN min(ord) = 1 THEN 'co-occurrence' ELSE 'code-vocabulary' END AS bridge, CASE WHEN min(ord) = 1 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM (SELECT * FROM hc UNION ALL SELECT * FROM cp) GROUP BY 1)"""
_LINKS = f"""lw AS (SELECT concept, bridge, unnest({_meaningful('label')}) AS word FROM merged), ln AS (SELECT concept, count(*) AS need FROM lw GROUP BY 1),
    lh AS (SELECT concept, bridge, uid FROM lw JOIN idx USING (word) JOIN ln USING (concept) GROUP BY concept, bridge, uid, need HAVING count(*) = need),
    links AS (SELECT concept, bridge, uid FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY uid) AS r FROM lh) WHERE r <= CASE bridge WHEN 'co-occurrence' THEN 12 ELSE 8 END)"""


@query(f"WITH {_CONCEPTS} SELECT * FROM merged")
def merged_concepts(s: SparkSession, d: str) -> DataFrame:
    """Concepts of headings and of the phrases of code, one for each id, with the label to show."""
    rows = concepts.merge_concepts(cut(_staged_concepts(s, d)))
    return rows.select("concept", T.concept_label(F.col("labels"), F.col("concept")).alias("label"), "bridge", "confidence")


@query(f"WITH {_INDEX}, {_CONCEPTS}, {_LINKS} SELECT concept, uid, CASE bridge WHEN 'co-occurrence' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM links")
def concept_links(s: SparkSession, d: str) -> DataFrame:
    merged = cut(concepts.merge_concepts(cut(_staged_concepts(s, d))))
    return concepts.concept_targets(merged, cut(concepts.grounding_index(tables.nodes(s, d))))


@query(f"WITH {_INDEX}, {_CONCEPTS}, {_LINKS} SELECT bridge, count(*) AS concepts, count(*) FILTER (concept IN (SELECT concept FROM links)) AS linked FROM merged GROUP BY 1")
def concept_overview(s: SparkSession, d: str) -> DataFrame:
    merged = cut(concepts.merge_concepts(cut(_staged_concepts(s, d))))
    return concepts.overview(merged, concepts.concept_targets(merged, cut(concepts.grounding_index(tables.nodes(s, d)))))


@query(f"""WITH {_CONCEPTS}, w AS (SELECT concept, {_meaningful("replace(concept, '_', ' ')")} AS own FROM merged),
    c AS (SELECT concept, own, len(list_intersect({_stems("['approval', 'discount', 'order']")}, {_stems('own')})) / 3 AS c FROM w)
    SELECT concept, round(c + 0.01 / greatest(len(own), 1), 4) AS score FROM c WHERE c > 0 ORDER BY score DESC, concept LIMIT 60""")
def asked_concepts(s: SparkSession, d: str) -> DataFrame:
    merged = concepts.merge_concepts(cut(_staged_concepts(s, d)))
    return concepts.resolve_concepts(merged, ["approval", "discount", "order"])


# -- scores of nodes ---------------------------------------------------------------------

ASKED = ["approval", "discount", "warehouse"]
_HITS = f"""h AS (SELECT n.uid, n.kind, n.name, n.path, top AS confidence, CAST(length(n.name) AS DOUBLE) AS relevance, payload FROM n WHERE kind IN ('Symbol', 'File') AND name IS NOT NULL),
    hw AS (SELECT *, {_stems(_meaningful("concat_ws(' ', name, translate(path, '/.', '  '), CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.summary') END)"))} AS own, {_stems(_meaningful("replace(path, '/', ' ')"))} AS pw FROM h),
    seeds AS (SELECT uid, round(least(greatest(relevance / max(relevance) OVER (), 0), 1) * CASE kind WHEN 'Symbol' THEN 0.85 ELSE 0.35 END * confidence
      * (0.35 + 0.65 * len(list_intersect({_stems(str(ASKED))}, own)) / 3) * (1 + coalesce(len(list_intersect({_stems(str(ASKED))}, pw)) / 3, 0)), 6) AS score FROM hw)"""


def _seeds(s: SparkSession, d: str) -> DataFrame:
    """Seeds for three words; the longer a name the more it is worth, so that every node has a score."""
    n = tables.nodes(s, d).where("kind in ('Symbol', 'File') and name is not null")
    return ranking.seed_scores(n.withColumn("relevance", F.length("name").cast("double")), ASKED)


@query(f"WITH {_NODES}, {_HITS} SELECT uid, score FROM seeds")
def seed_scores(s: SparkSession, d: str) -> DataFrame:
    return _seeds(s, d).select("uid", "score")


@query(f"""WITH {_NODES}, {_HITS}, k AS (SELECT n.path, n.uid, s.score FROM seeds s JOIN n USING (uid) WHERE n.kind = 'File' ORDER BY s.score DESC, n.uid LIMIT 6),
    i AS (SELECT n.uid, k.score * 0.8 AS score, row_number() OVER (PARTITION BY n.path ORDER BY n.line_start, n.uid) AS r FROM n JOIN k ON k.path = n.path WHERE n.kind = 'Symbol')
    SELECT uid, round(score, 6) AS score FROM i WHERE r <= 8""")
def fanned_out(s: SparkSession, d: str) -> DataFrame:
    n = tables.nodes(s, d)
    return ranking.fan_out(_seeds(s, d), n).select("uid", F.round("score", 6).alias("score"))


@query(f"""WITH {_NODES}, pr AS ({ORACLES['prior_topk']}), f AS (SELECT path, 0.9 * score / max(score) OVER () AS score FROM pr),
    r AS (SELECT n.uid, f.score / 2 AS score, row_number() OVER (PARTITION BY n.path ORDER BY n.line_start, n.uid) AS k FROM n JOIN f USING (path) WHERE n.kind = 'Symbol')
    SELECT n.uid, round(f.score, 6) AS score FROM n JOIN f USING (path) WHERE n.kind = 'File' UNION ALL SELECT uid, round(score, 6) FROM r WHERE k <= 6""")
def prior_boosts(s: SparkSession, d: str) -> DataFrame:
    from quarrylens.plans.queries import prior_topk

    prior = prior_topk(s, d)
    return ranking.history_scores(cut(prior), tables.nodes(s, d)).select("uid", F.round("score", 6).alias("score"))


@query(f"""WITH {_NODES}, k AS (SELECT name FROM n WHERE kind = 'Symbol' AND name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 5),
    v AS (SELECT uid, CAST(1.2 AS DOUBLE) AS score FROM n WHERE kind = 'Symbol' AND name IN (SELECT name FROM k) UNION ALL SELECT uid, 0.9 FROM n WHERE kind = 'Symbol' AND lower(name) IN (SELECT lower(name) FROM k))
    SELECT uid, max(score) AS best, round(sum(score), 4) AS total FROM v GROUP BY 1""")
def named_symbols(s: SparkSession, d: str) -> DataFrame:
    """Symbols of the five most used names, by their greatest score and by the sum of their scores."""
    n = tables.nodes(s, d).where("kind = 'Symbol'")
    names = [r.name for r in n.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "name").limit(5).collect()]
    found = ranking.verbatim_scores(n, names, [x.lower() for x in names])
    return ranking.bump(found).select("uid", F.col("score").alias("best")).join(ranking.boost(found).select("uid", F.round("score", 4).alias("total")), "uid")


# -- evaluation --------------------------------------------------------------------------


def _results(s: SparkSession, d: str) -> DataFrame:
    from quarrylens.plans.queries import outcomes

    repos = history.commits(table(s, d, "commits")).select(F.col("sha").alias("task"), "repo")
    return outcomes(s, d).join(repos, "task")


_ARMS = f"{_OUTCOMES}, res AS (SELECT o.*, repo FROM outcomes o JOIN tasks USING (task))"


@query(f"""WITH {_ARMS}, x AS (SELECT condition, coalesce(repo, 'ALL') AS repo, grouping(repo) AS g, count(*) AS tasks, round(avg(CASE WHEN first_hit_rank IS NULL THEN 0 ELSE 1 END), 4) AS hit_rate,
      round(avg(coalesce(1.0 / first_hit_rank, 0)), 4) AS mrr, round(avg(CASE WHEN recall >= 1 THEN 1 ELSE 0 END), 4) AS full_recall FROM res GROUP BY GROUPING SETS ((condition, repo), (condition)))
    SELECT condition, repo, tasks, hit_rate, mrr, full_recall FROM x""")
def arms_by_repository(s: SparkSession, d: str) -> DataFrame:
    return evaluate.arm_table(_results(s, d))


@query(f"""WITH {_ARMS}, g AS (SELECT a.task, a.first_hit_rank IS NOT NULL AS ra, b.first_hit_rank IS NOT NULL AS rb FROM res a JOIN res b ON a.task = b.task AND a.condition = 'often' AND b.condition = 'named')
    SELECT CASE WHEN ra AND rb THEN 'both' WHEN ra THEN 'only_first' WHEN rb THEN 'only_second' ELSE 'neither' END AS outcome, count(*) AS n FROM g GROUP BY 1""")
def common_grades(s: SparkSession, d: str) -> DataFrame:
    grades = cut(_results(s, d).select(F.col("task").alias("instance"), F.col("condition").alias("arm"), F.col("first_hit_rank").isNotNull().alias("resolved")))
    return evaluate.common_grades(grades, "often", "named")


@query(f"""WITH {_ARMS}, e AS (SELECT condition, first_hit_rank IS NOT NULL AS hit, recall, tokens_total > 250 AS bad FROM res)
    SELECT condition, count(*) FILTER (NOT bad) AS tasks, count(*) FILTER (NOT bad AND hit) AS hits, round(avg(recall) FILTER (NOT bad), 4) AS mean_recall, count(*) FILTER (bad) AS errors FROM e GROUP BY 1""")
def agent_summary(s: SparkSession, d: str) -> DataFrame:
    """Summary without the answers that cost too much, which count as errors."""
    rows = _results(s, d).select("condition", F.col("first_hit_rank").isNotNull().alias("hit"), "recall", F.when(F.col("tokens_total") > 250, "too long").alias("error"))
    return evaluate.agent_summary(rows).select("condition", "tasks", "hits", "mean_recall", "errors")


@query(f"""WITH {_ARMS}, h AS (SELECT condition, round(count(first_hit_rank) / count(*), 4) AS r FROM res GROUP BY 1)
    SELECT round(((SELECT r FROM h WHERE condition = 'often') - (SELECT r FROM h WHERE condition = 'named')) / nullif(1 - (SELECT r FROM h WHERE condition = 'named'), 0), 4) AS headroom""")
def headroom(s: SparkSession, d: str) -> DataFrame:
    """How far the better arm goes from the plainer one to knowing everything."""
    summary = evaluate.summarise(_results(s, d)).select("condition", "hit_rate").unionByName(s.createDataFrame([("all", 1.0)], "condition string, hit_rate double"))
    return evaluate.headroom(summary, "often", "named", "all")


@query(f"""WITH {_ARMS}, w AS (SELECT t.task, min(a.place) AS place, bool_or(tr.path IN (SELECT path_a FROM pairs UNION SELECT path_b FROM pairs)) AS connected
      FROM tasks t JOIN truth tr USING (task) LEFT JOIN arms a ON a.repo = t.repo AND a.q = t.f[1] AND a.path = tr.path AND a.condition = 'often' GROUP BY t.task, tr.path)
    SELECT CASE WHEN place IS NULL AND connected THEN 'unscored_connected' WHEN place IS NULL THEN 'unscored_unconnected' WHEN place > 5 THEN 'cut' WHEN place = 1 THEN 'first' WHEN place <= 3 THEN 'top3' ELSE 'late' END AS verdict, count(*) AS n FROM w GROUP BY 1""")
def rank_audit(s: SparkSession, d: str) -> DataFrame:
    """Where each wanted file of a commit stood among the partners of its first file."""
    c = history.commits(table(s, d, "commits")).where(F.size("files").between(2, 6)).select(F.col("sha").alias("task"), "repo", F.array_sort("files").alias("f"))
    asked = c.select("task", "repo", F.get("f", 0).alias("q"), F.explode(F.expr("slice(f, 2, size(f))")).alias("path")).where("path is not null")
    pairs = cut(history.co_changes(table(s, d, "commits")))
    both = pairs.select("repo", F.col("path_a").alias("q"), F.col("path_b").alias("path"), "support").unionByName(pairs.select("repo", F.col("path_b").alias("q"), F.col("path_a").alias("path"), "support"))
    placed = both.select("repo", "q", "path", F.row_number().over(Window.partitionBy("repo", "q").orderBy(F.desc("support"), "path")).alias("place"))
    linked = both.select("path").distinct().withColumn("connected", F.lit(True))
    ranks = asked.join(placed, ["repo", "q", "path"], "left").join(linked, "path", "left").select("task", "place", (F.col("place") <= 5).alias("offered"), F.coalesce("connected", F.lit(False)).alias("connected"))
    return evaluate.rank_audit(ranks)


@query(f"""WITH {_ARMS}, r AS (SELECT task, path, min(place) AS o, CAST(sum(tokens) AS BIGINT) AS tokens, 0 AS g FROM offers WHERE condition = 'often' AND place <= 2 GROUP BY 1, 2),
    f AS (SELECT task, path, place AS o, CAST(0 AS BIGINT) AS tokens, 1 AS g FROM offers x WHERE condition = 'often' AND {_extension()} IN ({', '.join(repr(c) for c in T.lex.CODE_LANGUAGES)}) AND (task, path) NOT IN (SELECT task, path FROM r))
    SELECT task, path, row_number() OVER (PARTITION BY task ORDER BY g, o, path) AS place, tokens FROM (SELECT * FROM r UNION ALL SELECT * FROM f)""")
def offered_order(s: SparkSession, d: str) -> DataFrame:
    """The two best offers of each commit as if read, then the other code files."""
    from quarrylens.plans.queries import retrieval_offers

    offers = cut(retrieval_offers(s, d)[0].where("condition = 'often'"))
    return evaluate.offered_order(offers.where("place <= 2").select("task", "path", F.col("place").alias("ord"), "tokens"), offers.select("task", "path", F.col("place").alias("rank")))
