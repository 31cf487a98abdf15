import itertools
import math
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarrylens.llm import cooccur, terms

COMMITS = "sha string, repo string, subject string, files array<string>, ingested_at timestamp"
EXTRACTS = "extract_id long, repo string, path string, vocabulary array<string>, extracted_at timestamp"


def messy(df):
    """The same frame with further columns whose names differ in letter case only."""
    return df.select("*", *[F.lit("clash").alias(c.upper()) for c in df.columns])


def ts(k):
    from datetime import datetime

    return datetime(2025, 1, 1, k)


def test_terms_are_runs_of_letters_without_one_plural(spark):
    rows = spark.createDataFrame([("Invoices; class BUS ab x1tax9 sửa",)], "t string").select(terms.terms_of(F.col("t")).alias("w"))
    assert rows.first().w == ["invoice", "class", "bus", "tax", "sửa"]


def test_residuals_agree_with_plain_arithmetic(spark):
    data = {"a": ["x", "x", "y"], "b": ["y", "z"], "c": ["y"], "d": []}
    frame = spark.createDataFrame([(k, v) for k, v in data.items()], "k string, uses array<string>")
    total = sum(map(len, data.values()))
    columns = Counter(itertools.chain(*data.values()))
    got = {(r.k, r.term): r for r in terms.distinctive_terms(frame, ["k"]).collect()}
    assert set(got) == {(k, t) for k, v in data.items() for t in v}
    for (k, t), r in got.items():
        row, col, n = len(data[k]), columns[t], data[k].count(t)
        e = row * col / total
        assert math.isclose(r.residual, (n - e) / math.sqrt(e * (1 - row / total) * (1 - col / total)), abs_tol=1e-9)
        assert (r.uses, r.record_uses, r.term_uses, r.term_records) == (n, row, col, sum(t in v for v in data.values()))


def test_one_record_with_one_term_scores_zero(spark):
    frame = spark.createDataFrame([("a", ["x", "x"])], "k string, uses array<string>")
    assert terms.distinctive_terms(frame, ["k"]).first().residual == 0.0


def test_found_takes_nulls_repeats_long_and_empty_tables(spark):
    c = [("AB", "r", "odd vouchers", None, ts(1)), ("ab", "r", "odd vouchers", None, ts(2)), ("cd", "q", "voucher " + "long " * 50_000, None, ts(1)), (None, "r", "voucher", None, ts(1)), ("ef", "r", None, None, ts(1)), ("gh", "r", "", None, None)]
    x = [(1, "r", "p", ["Alphas"] * 5, ts(1)), (2, "r", "p", ["beta"] * 5 + [None, ""], ts(2)), (3, "q", "p2", ["beta"] * 4, ts(1)), (4, "q", None, ["beta"] * 9, ts(1)), (5, "q", "p3", None, ts(1))]
    commits, extracts = messy(spark.createDataFrame(c, COMMITS)), messy(spark.createDataFrame(x, EXTRACTS))
    got = {tuple(r) for r in terms.found(commits, extracts).collect()}
    assert got == {("commit", "r", "ab", "voucher"), ("commit", "q", "cd", "voucher"), ("file", "r", "p", "beta")}
    assert terms.found(spark.createDataFrame([], COMMITS), spark.createDataFrame([], EXTRACTS)).count() == 0


def baskets(spark, rows):
    return spark.createDataFrame([(b, g, sorted(i)) for b, g, i in rows], "basket string, grp string, items array<string>")


def brute(rows):
    out = Counter()
    for _, g, items in rows:
        out[(g, None, None)] += 1
        for i in set(items):
            out[(g, i, None)] += 1
        for a, b in itertools.combinations(sorted(set(items)), 2):
            out[(g, a, b)] += 1
    return dict(out)


def counted(df):
    return {(r.grp, r.a, r.b): r.n for r in df.collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("gh"), st.sets(st.sampled_from("abcde"), max_size=5)), max_size=8))
def test_deltas_count_as_brute_force(spark, data):
    rows = [(str(k), g, i) for k, (g, i) in enumerate(data)]
    assert counted(cooccur.deltas(None, baskets(spark, rows))) == brute(rows)


def test_wide_baskets_list_every_pair(spark):
    rows = [("1", "g", {f"i{k:03d}" for k in range(150)})]
    assert counted(cooccur.deltas(None, baskets(spark, rows))) == brute(rows)


def test_updates_reach_the_counts_of_a_full_run_and_rescore_what_moved(spark, tmp_path):
    t = cooccur.PairTable(spark, f"file://{tmp_path}/pairs", buckets=8)
    first = [("1", "g", {"a", "b"}), ("2", "g", {"a", "b", "c"}), ("3", "h", {"x", "y"})]
    t.update(None, baskets(spark, first))
    second = [("1", "g", {"a", "b"}), ("2", "g", {"a", "c"}), ("3", "h", {"x", "y"}), ("4", "g", set())]
    moved = t.update(baskets(spark, first), baskets(spark, second))
    assert counted(t.counts()) == brute(second)
    scores = {(r.grp, r.a, r.b): (r.shared, r.total) for r in moved.collect()}
    assert scores == {("g", "a", "b"): (1, 3), ("g", "a", "c"): (1, 3)}
    assert {(r.grp, r.a, r.b): (r.shared, r.total) for r in t.scores().collect()} == scores | {("h", "x", "y"): (1, 1)}
    t.update(baskets(spark, second), baskets(spark, []))
    assert t.counts().count() == 0 and t.scores().count() == 0
    assert t.update(None, baskets(spark, [])).count() == 0


def test_steps_reach_the_scores_of_one_recount(spark, monkeypatch):
    """Fed in one, two and five batches, with deliveries of one commit in several, the hits are those of a plain count."""
    import random

    rng = random.Random(4)
    files = [f"f{k}" for k in range(9)]
    commits = [(f"c{k % 40}".upper() if k % 3 else f"c{k % 40}", "rq"[k % 40 % 2], None, rng.sample(files, rng.randrange(5)), ts(k % 24) if k % 7 else None) for k in range(60)]
    frame = spark.createDataFrame(commits, COMMITS)
    own = {}
    for sha, repo, _, held, _ in commits:
        own.setdefault((sha.lower(), repo), set()).update(held)
    n = brute([(b, g, i) for (b, g), i in own.items()])
    want = {k for k, shared in n.items() if k[2] and shared >= 3 and shared * n[(k[0], None, None)] >= 1 * n[(k[0], k[1], None)] * n[(k[0], k[2], None)]}
    assert want
    monkeypatch.setattr(cooccur.PairTable, "MOST_SEGMENTS", 2)
    for steps in (1, 2, 4):
        assert {tuple(r) for r in cooccur.found(frame, shared=3, times=1, steps=steps).collect()} == want


def test_found_pairs(spark):
    rows = [(f"S{k}", "r", None, ["a", "b", "b", None], ts(1)) for k in range(5)] + [("s0", "r", None, ["b", "a"], ts(2))] + [(f"t{k}", "r", None, None if k % 2 else ["c"], ts(1)) for k in range(20)] + [(None, "r", None, ["a", "b"], ts(1))]
    commits = spark.createDataFrame(rows, COMMITS)
    assert [tuple(r) for r in cooccur.found(messy(commits)).collect()] == [("r", "a", "b")]
    assert cooccur.found(commits.where("repo = 'none'")).count() == 0
    perfect = cooccur.associate(cooccur.deltas(None, baskets(spark, [("1", "g", {"a", "b"})]))).first()
    assert perfect.npmi == 1.0 and perfect.lift == 1.0
