"""Full-text search: postings, BM25, substring and content scans, packing."""

from __future__ import annotations

import unicodedata
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def tokens(text: Column) -> Column:
    """Lower-case identifiers of three letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]{2,})"), F.lit(1))


# Latin letters with diacritics; what they fold to follows from Unicode.
ACCENTED = "àáâãäåāăąạảấầẩẫậắằẳẵặçćčďđèéêëēėęěẹẻẽếềểễệìíîïīįịỉĩñńňòóôõöøōőọỏốồổỗộớờởỡợơùúûüūůűụủứừửữựưýÿỳỵỷỹžźżšśřť"
PLAIN = "".join({"đ": "d", "ø": "o"}.get(c) or unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters, single or combining, for tokens of any script."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[\\x{300}-\\x{36F}]", "")


def words(text: Column) -> Column:
    """Folded words of any script: runs of letters, their marks and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def folded_words(text: str) -> list[str]:
    """The same for a query, on the driver."""
    low = "".join(c for c in text.lower().translate(str.maketrans(ACCENTED, PLAIN)) if not 0x300 <= ord(c) <= 0x36F)
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", low)


def _postings(docs: DataFrame, key: str, found: Column) -> DataFrame:
    listed = docs.select(key, found.alias("__t")).where(F.size("__t") > 0)
    return listed.select(key, F.size("__t").cast("long").alias("dl"), F.explode("__t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf, dl): an inverted index of the identifiers of whole texts; documents without any are left out."""
    return _postings(docs, key, tokens(F.col(body)))


def word_postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """The same of the words of any script."""
    return _postings(docs, key, words(F.col(body)))


class PostingStore:
    """Postings on disk in ranges of terms, so a query reads the row groups its terms fall into, and their totals."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def write(self, index: DataFrame) -> PostingStore:
        """Store an index; ``root`` must be new."""
        index.repartitionByRange("term", self.key).sortWithinPartitions("term").write.parquet(f"{self.root}/postings")
        totals(self.read(), self.key).write.parquet(f"{self.root}/totals")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def search(self, query: list[str], most: int | None = 60) -> DataFrame:
        return prefix_search(self.read(), self.key, query, most=most, whole=self.spark.read.parquet(f"{self.root}/totals"))

    def bm25(self, query: list[str], most: int | None = 20) -> DataFrame:
        """As ``bm25``, from the stored postings of identifiers."""
        return bm25_of(self.read().where(F.col("term").isin(sorted(set(query)))), self.key, self.spark.read.parquet(f"{self.root}/totals"), most)


def totals(index: DataFrame, key: str) -> DataFrame:
    """One row: documents and their mean length."""
    return index.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))


def bm25_of(hits: DataFrame, key: str, whole: DataFrame, most: int | None = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score, matched) from the postings of the asked terms and the totals of the index."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # one row for each asked term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    scored = joined.groupBy(key).agg(F.round(F.sum(part), 4).alias("score"), F.count(F.lit(1)).cast("int").alias("matched")).where("score > 0")
    return scored if most is None else scored.orderBy(F.desc("score"), key).limit(most)


def bm25(docs: DataFrame, key: str, body: str, query: list[str], most: int | None = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score, matched) best first, for the distinct terms of a query.

    idf is ln(1 + (N - df + .5) / (df + .5)) over the documents with tokens. One pass over
    the texts counts the asked terms where they stand; only matching rows are shuffled.
    """
    asked = sorted(set(query))
    found = docs.select(key, tokens(F.col(body)).alias("__t")).where(F.size("__t") > 0)
    uses = lambda q: F.size(F.filter("__t", lambda t: t == q))
    counts = [uses(q).alias(f"__tf{i}") for i, q in enumerate(asked)]
    rows = found.select(key, F.size("__t").cast("double").alias("__dl"), *counts)
    whole = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(asked))])
    joined = rows.where(reduce(lambda x, y: x | y, [F.col(f"__tf{i}") > 0 for i in range(len(asked))])).crossJoin(F.broadcast(whole))
    length = k1 * (1 - b + b * F.col("__dl") / F.col("__avg"))
    parts = []
    for i in range(len(asked)):
        idf = F.log(1 + (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        parts.append(F.when(F.col(f"__tf{i}") > 0, idf * F.col(f"__tf{i}") * (k1 + 1) / (F.col(f"__tf{i}") + length)).otherwise(F.lit(0.0)))
    scored = joined.select(key, F.round(reduce(lambda x, y: x + y, parts), 4).alias("score"), reduce(lambda x, y: x + y, [(F.col(f"__tf{i}") > 0).cast("int") for i in range(len(asked))]).alias("matched"))
    scored = scored.where("score > 0")
    return scored if most is None else scored.orderBy(F.desc("score"), key).limit(most)


def _plain_stem(word: str) -> str:
    return word[:-1] if len(word.encode()) > 3 and word.endswith("s") and not word.endswith("ss") else word


def prefix_search(index: DataFrame, key: str, query: list[str], k1: float = 1.2, b: float = 0.75, most: int | None = 60, whole: DataFrame | None = None) -> DataFrame:
    """(key, score): BM25 over an index of postings where ASCII terms of five letters match as stemmed prefixes.

    ``whole`` gives the totals of the index where they are stored. The conditions on terms are
    literals, so a stored index is read only where they can hold.
    """
    asked = sorted({(_plain_stem(q), True) if len(q) >= 5 and q.isascii() else (q, False) for w in query for q in folded_words(w)})
    if not asked:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    holds = [F.startswith("term", F.lit(q)) if wide else F.col("term") == q for q, wide in asked]
    hit = index.where(reduce(lambda x, y: x | y, holds)).withColumn("q", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(q)) for h, (q, _) in zip(holds, asked)]))))
    tf = hit.groupBy(key, "dl", "q").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("q").agg(F.count(F.lit(1)).alias("df"))  # one row for each asked term
    scored = tf.join(F.broadcast(df), "q").crossJoin(F.broadcast(totals(index, key) if whole is None else whole))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    value = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    ranked = scored.groupBy(key).agg(F.round(F.sum(value), 4).alias("score"))
    return ranked if most is None else ranked.orderBy(F.desc("score"), key).limit(most)


def substring_search(docs: DataFrame, key: str, body: str, terms: list[str], most: int = 60) -> DataFrame:
    """(key, matched): texts beyond ASCII that hold a term of three letters or more anywhere; for when nothing else matches."""
    asked = sorted({t.lower() for t in terms if len(t) >= 3})
    low = F.lower(F.col(body))
    matched = reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in asked], F.lit(0))
    rows = docs.where(F.octet_length(body) != F.char_length(body)).select(key, matched.alias("matched"))
    return rows.where("matched > 0").orderBy(F.desc("matched"), key).limit(most)


def content_scan(files: DataFrame, key: str, body: str, terms: list[str], most: int | None = 12, cap: int = 50) -> DataFrame:
    """(key, distinct_terms, uses, score): how many asked words a text holds and how often, each up to ``cap`` times.

    Score is distinct + uses / 200, as a share of the best.
    """
    low = F.lower(F.col(body))
    counts = [F.least(F.floor((F.length(low) - F.length(F.replace(low, F.lit(t)))) / len(t)), F.lit(cap)).cast("long") for t in sorted(set(terms))]
    rows = files.where(F.col(body).isNotNull()).select(key, F.array(*counts).alias("c"))
    distinct = F.size(F.filter("c", lambda x: x > 0)).cast("long")
    uses = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.select(key, distinct.alias("distinct_terms"), uses.alias("uses")).where("distinct_terms > 0")
    raw = rows.withColumn("raw", F.col("distinct_terms") + F.col("uses") / 200)
    best = raw.agg(F.max("raw").alias("best"))
    scored = raw.crossJoin(F.broadcast(best)).select(key, "distinct_terms", "uses", F.round(F.col("raw") / F.col("best"), 4).alias("score"))
    return scored if most is None else scored.orderBy(F.desc("distinct_terms"), F.desc("uses"), key).limit(most)


def path_scan(files: DataFrame, path: str, terms: list[str], most: int = 12) -> DataFrame:
    """(path, matched): how many asked words stand in a path."""
    low = F.lower(F.col(path))
    matched = reduce(lambda a, b: a + b, [low.contains(t.lower()).cast("int") for t in sorted(set(terms))], F.lit(0))
    return files.select(path, matched.alias("matched")).where("matched > 0").orderBy(F.desc("matched"), path).limit(most)


def pack(ranked: DataFrame, key: str, size: str, order: list[Column], budget: int) -> DataFrame:
    """(key, taken): whole texts in rank order until the budget, the last one cut to what is left.

    Every text taken costs one at least, so no more than ``budget`` of them can be; one window
    over these is enough. Texts of no size take nothing and are left out.
    """
    first = ranked.where(F.col(size) > 0).orderBy(*order).limit(budget)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = first.withColumn("__end", F.sum(size).over(w))
    return rows.where(F.col("__end") - F.col(size) < budget).select(key, F.least(F.col(size), budget - (F.col("__end") - F.col(size))).alias("taken"))
