"""Concepts: business vocabulary grounded in code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T

# Targets a concept keeps, by where it comes from; precedence is this order.
MAX_LINKS = {"declared": 24, "translation": 16, "co-occurrence": 12, "code-vocabulary": 8}
# Confidence of the link from a concept to a symbol, by where the concept comes from.
LINK_CONFIDENCE = {"declared": 0.95, "translation": 0.8, "co-occurrence": 0.6, "code-vocabulary": 0.5}


def grounding_index(nodes: DataFrame) -> DataFrame:
    """(word, uid): the words of the names of symbols and tables."""
    live = nodes.where(F.col("kind").isin("Symbol", "DatabaseObject") & F.col("name").isNotNull())
    words = F.array_except(T.split_identifier("name"), F.array(*[F.lit(w) for w in T.lex.STOPWORD_LIST]))
    return live.select("uid", F.explode(F.filter(words, lambda w: F.octet_length(w) >= 3)).alias("word")).distinct()


def ground(labels: DataFrame, index: DataFrame, most: int = 24, relaxed: bool = False, least: int = 1) -> DataFrame:
    """(label, uid) of the names that hold all words of a label, at most ``most`` by uid.

    labels: label, words. ``relaxed`` leaves out words no name has; ``least`` known words are
    needed. Candidates are the names with a label's rarest word, so frequent words join nothing.
    """
    uses = index.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    each = labels.select("label", F.explode(F.array_distinct("words")).alias("word")).join(uses, "word", "left")
    wanted = each.groupBy("label").agg(F.collect_list(F.when(F.col("uses").isNotNull(), F.col("word"))).alias("need"), F.count(F.lit(1)).alias("words"), F.min(F.when(F.col("uses").isNotNull(), F.struct("uses", "word"))).alias("rare"))
    able = wanted.where((F.size("need") >= least) & (F.lit(relaxed) | (F.size("need") == F.col("words"))))
    names = index.groupBy("uid").agg(F.collect_set("word").alias("have"))
    candidates = able.select("label", "need", F.col("rare.word").alias("word")).join(index, "word").join(names, "uid")
    whole = candidates.where(F.size(F.array_except("need", "have")) == 0).select("label", "uid")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("uid"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= most).select("label", "uid")


def code_phrases(symbols: DataFrame, share: float = 0.02, floor: int = 25, least: int = 3, most: int = 400) -> DataFrame:
    """(phrase, symbols): pairs of neighbouring words in names of ``least`` symbols or more, without ubiquitous words.

    A word is ubiquitous in more than ``share`` of all symbols, and more than ``floor``.
    """
    words = symbols.select("uid", T.split_identifier("name").alias("w"))
    limit = words.agg(F.greatest(F.count(F.lit(1)) * share, F.lit(floor)).alias("limit"))
    common = words.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(limit)).where("n > limit").select("word")
    pairs = words.where(F.size("w") > 1).select("uid", F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> struct(w[i] AS a, w[i + 1] AS b))")).alias("p")).select("uid", "p.a", "p.b").distinct()
    kept = pairs.where((F.length("a") >= 3) & (F.length("b") >= 3)).join(common.withColumnRenamed("word", "a"), "a", "left_anti").join(common.withColumnRenamed("word", "b"), "b", "left_anti")
    counted = kept.groupBy(F.concat_ws(" ", "a", "b").alias("phrase")).agg(F.count_distinct("uid").alias("symbols")).where(F.col("symbols") >= least)
    return counted.orderBy(F.desc("symbols"), "phrase").limit(most)


def heading_concepts(sections: DataFrame, index: DataFrame, most: int = 400) -> DataFrame:
    """(concept, label, grounded): headings whose words all stand in one name; the first label of an id holds."""
    labels = sections.where("title is not null").select(F.col("title").alias("label"), T.meaningful_words("title").alias("words")).where(F.size("words") > 0).dropDuplicates(["label"])
    hits = ground(labels, index).groupBy("label").agg(F.count(F.lit(1)).alias("grounded"))
    merged = hits.groupBy(T.normalize_id("label").alias("concept")).agg(F.min("label").alias("label"), F.max("grounded").alias("grounded"))
    return merged.orderBy(F.desc("grounded"), "concept").limit(most)


def translation_concepts(translations: DataFrame, index: DataFrame, lang: str) -> DataFrame:
    """(concept, labels): source texts of translation rows with a word of four bytes and a name that holds their words.

    translations: ord, source, target. The last row of an id gives its labels.
    """
    rows = translations.select("ord", "source", "target", F.col("source").alias("label"), T.meaningful_words("source").alias("words"))
    able = rows.where(F.exists("words", lambda w: F.octet_length(w) >= 4))
    hit = ground(able.select("label", "words").dropDuplicates(["label"]), index).select("label").distinct()
    kept = able.join(hit, "label", "left_semi").groupBy(T.normalize_id("source").alias("concept")).agg(F.max_by(F.struct("source", "target"), "ord").alias("r"))
    return kept.select("concept", F.create_map(F.lit("eng"), F.col("r.source"), F.lit(lang), F.col("r.target")).alias("labels"))


def join_bundles(bundles: DataFrame) -> DataFrame:
    """(base, locale, source, target): messages of a bundle and of its translations by key, equal texts left out.

    bundles: base, locale (null for the source), key, value.
    """
    source = bundles.where("locale is null").select("base", "key", F.col("value").alias("source"))
    target = bundles.where("locale is not null").select("base", "key", "locale", F.col("value").alias("target"))
    return source.join(target, ["base", "key"]).where("source <> target").select("base", "locale", "key", "source", "target")


def merge_concepts(concepts: DataFrame) -> DataFrame:
    """One row for each concept: joined labels (the first of a language), united code and tables, strongest status and bridge.

    concepts: ord, concept, lang, label, code, tables, bridge, status, confidence.
    """
    order = list(MAX_LINKS)
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("bridge"))
    labels = concepts.where("label is not null").groupBy("concept", "lang").agg(F.min_by("label", "ord").alias("label"))
    labels = labels.groupBy("concept").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "label")))).alias("labels"))
    rest = concepts.groupBy("concept").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("code", F.array().cast("array<string>")))))).alias("code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tables", F.array().cast("array<string>")))))).alias("tables"),
        F.min_by("bridge", F.struct(rank, "ord")).alias("bridge"),
        F.max_by("status", F.struct(F.array_position(F.array(*[F.lit(s) for s in T.lex.STATUS_ORDER]), F.col("status")), -F.col("ord"))).alias("status"),
        F.max("confidence").alias("confidence"),
    )
    return rest.join(labels, "concept", "left")


def concept_targets(concepts: DataFrame, index: DataFrame) -> DataFrame:
    """(concept, uid, confidence): names holding all words of one of its labels, or of a code identifier; capped by bridge."""
    label_rows = concepts.select("concept", "bridge", F.explode(F.map_values("labels")).alias("text")).unionByName(concepts.select("concept", "bridge", F.explode("code").alias("text")))
    keyed = label_rows.select("concept", "bridge", F.concat_ws("\x00", "concept", "text").alias("label"), T.meaningful_words("text").alias("words")).where(F.size("words") > 0)
    hits = ground(keyed.select("label", "words").dropDuplicates(["label"]), index, most=1 << 30).join(keyed.select("label", "concept", "bridge").distinct(), "label")
    once = hits.select("concept", "bridge", "uid").distinct()
    cap = F.coalesce(F.try_element_at(F.create_map(*[x for b, n in MAX_LINKS.items() for x in (F.lit(b), F.lit(n))]), F.col("bridge")), F.lit(8))
    sure = F.coalesce(F.try_element_at(F.create_map(*[x for b, n in LINK_CONFIDENCE.items() for x in (F.lit(b), F.lit(n))]), F.col("bridge")), F.lit(0.5))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy("uid"))
    return once.withColumn("rank", rank).where(F.col("rank") <= cap).select("concept", "uid", sure.alias("confidence"))


def overview(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(bridge, concepts, linked): concepts by where they come from, and those with a target."""
    hit = links.select("concept").distinct().withColumn("hit", F.lit(1))
    return concepts.join(hit, "concept", "left").groupBy("bridge").agg(F.count(F.lit(1)).alias("concepts"), F.count("hit").alias("linked"))


def resolve_concepts(concepts: DataFrame, asked: list[str], most: int = 60) -> DataFrame:
    """(concept, score) by the share of asked words in an id's words, shorter ids first among equals."""
    words = F.array(*[F.lit(w) for w in sorted(set(asked))])
    own = T.meaningful_words(F.translate("concept", "_", " "))
    score = F.round(T.coverage(words, own) + F.lit(0.01) / F.greatest(F.size(own), F.lit(1)), 4)
    return concepts.select("concept", score.alias("score"), T.coverage(words, own).alias("c")).where("c > 0").select("concept", "score").orderBy(F.desc("score"), "concept").limit(most)
