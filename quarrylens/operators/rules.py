"""Rules mined from documents and code, their corroboration and their conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T

COLUMNS = ["rule", "subject", "polarity", "source", "claim", "anchor", "location", "confidence"]


def _candidates(rows: DataFrame, source: str) -> DataFrame:
    """rows: claim, anchor, location."""
    said = rows.withColumn("said", T.classify_phrase("claim")).where("said is not null")
    return said.select(
        T.rule_id(F.col("said.subject"), F.col("said.polarity"), F.col("claim")).alias("rule"), "said.subject", "said.polarity", F.lit(source).alias("source"), "claim", "anchor", "location",
        F.lit(T.lex.RULE_STRENGTH[source]).alias("confidence"),
    )


def mine_documents(sections: DataFrame) -> DataFrame:
    """Obliging or exempting sentences of sections; sections: uid, path, line_no, body. Histories are left out."""
    rows = sections.where(T.is_specification("path")).select("uid", "path", "line_no", F.explode(T.sentences("body")).alias("claim"))
    rows = rows.where(T.is_checkable("claim") & T.has_modal("claim"))
    return _candidates(rows.select("claim", F.col("uid").alias("anchor"), T.location(F.col("path"), F.col("line_no"), F.col("uid")).alias("location")), "document")


def mine_code(symbols: DataFrame) -> DataFrame:
    """Rules that names of tests, guards and documentation state; symbols: uid, name, path, line_start, documentation, body."""
    place = T.location(F.col("path"), F.col("line_start"), F.col("uid")).alias("location")
    tests = symbols.where(T.is_test_path("path") & F.lower("name").rlike("^test")).select(T.humanise(F.regexp_replace("name", "^[Tt]est_?", "")).alias("claim"), F.col("uid").alias("anchor"), place)
    lines = symbols.select("uid", "path", "line_start", F.split("body", "\n").alias("l"))
    guards = lines.select("uid", "path", "line_start", F.posexplode(F.transform("l", lambda x, i: F.when(F.trim(x).rlike(r"^(if|elif|else if|unless|when)\b"), F.array_join(F.slice(F.col("l"), i + 1, 4), " ")))).alias("at", "claim"))
    guards = guards.where("claim is not null").select(T.humanise("claim").alias("claim"), F.col("uid").alias("anchor"), T.location(F.col("path"), F.col("line_start") + F.col("at"), F.col("uid")).alias("location"))
    told = symbols.where("documentation is not null").select("uid", "path", "line_start", F.explode(T.sentences("documentation")).alias("claim")).where(T.is_checkable("claim") & T.has_modal("claim"))
    docs = told.select("claim", F.col("uid").alias("anchor"), place)
    return _candidates(tests.where(T.is_checkable("claim")), "test").unionByName(_candidates(guards, "code_guard")).unionByName(_candidates(docs, "code_doc"))


def distinct_rules(rules: DataFrame) -> DataFrame:
    """For each subject, polarity, source and anchor the shortest claim, then the first in order."""
    rank = F.row_number().over(Window.partitionBy("subject", "polarity", "source", "anchor").orderBy(F.length("claim"), "claim", "location"))
    return rules.withColumn("rank", rank).where("rank = 1").drop("rank")


def corroborate(rules: DataFrame, gain: float = 0.15, most: float = 0.97) -> DataFrame:
    """Adds ``corroborated``, the number of other kinds of source with the same subject and polarity, and ``status``.

    Each other kind raises confidence by ``gain`` of itself, up to ``most``; two make a rule OBSERVED.

    Kinds are counted for each subject and polarity first, so no group of rules is gathered.
    """
    kinds = rules.groupBy("subject", "polarity").agg(F.size(F.collect_set("source")).alias("kinds"))
    joined = rules.join(F.broadcast(kinds), ["subject", "polarity"])  # subjects and polarities are a fixed list
    return joined.withColumn("corroborated", F.col("kinds") - 1).withColumn("confidence", F.when(F.col("corroborated") > 0, F.round(F.least(F.col("confidence") * (1 + gain * F.col("corroborated")), F.lit(most)), 4)).otherwise(F.col("confidence"))).withColumn("status", F.when(F.col("corroborated") >= 2, "OBSERVED").otherwise("INFERRED")).drop("kinds")


def claim_stems(claim, subject):
    """Sorted stems of a claim's words without those that name its subject."""
    own = None
    for name, (terms, _, _) in T.lex.SUBJECTS.items():
        words = F.array(*[F.lit(w) for w in sorted({w for t in terms.split("|") for w in t.split()})])
        own = F.when(subject == name, words) if own is None else own.when(subject == name, words)
    return F.array_sort(F.array_distinct(F.transform(F.array_except(T.meaningful_words(claim), own), T.stem)))


def conflicts(rules: DataFrame, shared: int = 2, floor: float = 0.7) -> DataFrame:
    """(conflict, documented, observed, subject, documented_claim, observed_claim): a document against code.

    Same subject, opposite polarity, ``shared`` common stems or more beyond the subject's own
    words, both sure enough. Sides meet on their stems, counted after the join, so a subject
    that many rules share does not pair them all.
    """
    sure = rules.where(F.col("confidence") >= floor).withColumn("stem", F.explode(claim_stems(F.col("claim"), F.col("subject"))))
    left = sure.where("source = 'document'").select("subject", "stem", F.col("rule").alias("documented"), F.col("polarity").alias("p1"), F.col("claim").alias("documented_claim"))
    right = sure.where("source <> 'document'").select("subject", "stem", F.col("rule").alias("observed"), F.col("polarity").alias("p2"), F.col("claim").alias("observed_claim"))
    met = left.join(right, ["subject", "stem"]).where("p1 <> p2")
    pairs = met.groupBy("documented", "observed", "subject", "documented_claim", "observed_claim").agg(F.count_distinct("stem").alias("shared")).where(F.col("shared") >= shared)
    return pairs.select(T.conflict_id(F.col("documented"), F.col("observed")).alias("conflict"), "documented", "observed", "subject", "documented_claim", "observed_claim", "shared")


def staged(rules: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) of rules and conflicts: IMPLEMENTS_RULE from anchors, CONTRADICTS from conflicts to both anchors."""
    as_node = lambda df, uid, claim: df.select(F.col(uid).alias("uid"), F.lit("BusinessRule").alias("kind"), F.left(F.col(claim), F.lit(80)).alias("name"), F.to_json(F.struct(F.col(claim).alias("claim"))).alias("payload"))
    first = lambda df, uid, claim: df.groupBy(uid).agg(F.min(claim).alias(claim))
    nodes = as_node(first(rules, "rule", "claim"), "rule", "claim").unionByName(as_node(first(found, "conflict", "documented_claim"), "conflict", "documented_claim"))
    edges = rules.select(F.col("anchor").alias("src"), F.col("rule").alias("dst"), F.lit("IMPLEMENTS_RULE").alias("kind"), "confidence")
    anchors = rules.select("rule", "anchor").distinct()
    sides = found.select("conflict", F.explode(F.array("documented", "observed")).alias("rule")).join(anchors, "rule")
    edges = edges.unionByName(sides.select(F.col("conflict").alias("src"), F.col("anchor").alias("dst"), F.lit("CONTRADICTS").alias("kind"), F.lit(0.8).alias("confidence")))
    evidence = rules.select(F.col("rule").alias("uid"), "source", F.col("location").alias("locator"))
    return nodes, edges, evidence


def strong_rules(rules: DataFrame, floor: float = 0.7) -> DataFrame:
    return rules.where((F.col("confidence") >= floor) & ~F.col("rule").startswith("conflict:")).orderBy(F.desc("confidence"), "rule")
