"""Choosing what to show within a budget of tokens.

Greedy selection is sequential and its candidates are a bounded top list, so the kernels
work on the driver's rows or on one group of a query.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The most nodes of a kind, and the share of the budget they may take.
KIND_CAPS = {"Concept": (6, 0.20), "DocSection": (5, 0.30), "BusinessRule": (6, 0.25), "Commit": (4, 0.10), "DatabaseObject": (6, 0.15), "Symbol": (20, 0.60), "File": (0, 0.05)}
ANSWER_SHARE = 0.4


def select(candidates: Iterable[dict], budget: int) -> list[dict]:
    """Candidates (uid, kind, score, tokens, conflicted) that fit, in the order they were taken.

    Conflicts come first and always; then the best concept and the best section; then the
    most score for a token within the caps of each kind; what is left goes to symbols.
    """
    rows = sorted(candidates, key=lambda r: (-(r["score"] / max(1, r["tokens"])), r["uid"]))
    taken: list[dict] = []
    used, by_kind, spent = 0, {}, {}

    def take(r: dict) -> None:
        nonlocal used
        taken.append(r)
        used += r["tokens"]
        by_kind[r["kind"]] = by_kind.get(r["kind"], 0) + 1
        spent[r["kind"]] = spent.get(r["kind"], 0) + r["tokens"]

    for r in rows:
        if r.get("conflicted"):
            take(r)
    used = 0  # conflicts cost nothing
    for kind in ("Concept", "DocSection"):
        best = max((r for r in rows if r["kind"] == kind and r not in taken), key=lambda r: (r["score"], r["uid"]), default=None)
        if best and used + best["tokens"] <= budget:
            take(best)
    for r in rows:
        count, share = KIND_CAPS.get(r["kind"], (6, 0.15))
        if r not in taken and used + r["tokens"] <= budget and by_kind.get(r["kind"], 0) < count and spent.get(r["kind"], 0) + r["tokens"] <= share * budget:
            take(r)
    for r in rows:
        if r["kind"] == "Symbol" and r not in taken and used + r["tokens"] <= budget:
            take(r)
    return taken


def contenders(candidates: DataFrame, budget: int) -> DataFrame:
    """The candidates that ``select`` may take, all others left out: exact, and bounded by the budget.

    candidates: query, uid, kind, score, tokens, conflicted. Of nodes of one kind and cost, those with
    more score come first, and no more than the budget holds fit; the best of a kind is kept by the
    order in which ``select`` picks it.
    """
    cost = F.greatest(F.col("tokens"), F.lit(1))
    alike = F.row_number().over(Window.partitionBy("query", "kind", "tokens").orderBy(F.desc("score"), "uid"))
    best = F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.desc("score"), F.desc("uid")))
    always = candidates.where("conflicted")
    free = candidates.where("not conflicted and tokens <= 0")
    fitting = candidates.where(~F.col("conflicted") & F.col("tokens").between(1, budget))
    first = fitting.withColumn("__k", alike).where(F.col("__k") <= budget).where(F.col("__k") <= F.floor(F.lit(budget) / cost)).drop("__k")
    top = fitting.withColumn("__k", best).where(F.col("__k") <= 1).drop("__k")
    return always.unionByName(free).unionByName(first).unionByName(top).dropDuplicates(["query", "uid"])


def select_each(candidates: DataFrame, budget: int) -> DataFrame:
    """(query, uid, place) of the selection for each query; a query's candidates are its top list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = select(pdf.to_dict("records"), budget)
        return pd.DataFrame({"query": [r["query"] for r in rows], "uid": [r["uid"] for r in rows], "place": range(len(rows))}).astype({"place": "int64"})

    return candidates.groupBy("query").applyInPandas(run, "query string, uid string, place long")


def take_within(ranked: Iterable[dict], budget: int) -> list[dict]:
    """Ranked rows with tokens that still fit, in order, skipping those that do not."""
    out, left = [], budget
    for r in ranked:
        if r["tokens"] <= left:
            out.append(r)
            left -= r["tokens"]
    return out


def reading_plan(regions: Iterable[dict], budget: int, most: int = 6, per_line: int = 10) -> list[dict]:
    """The first regions (path, start, end) in order that still fit, skipping those that do not."""
    plan: list[dict] = []
    left = budget
    for r in regions:
        cost = (r["end"] - r["start"] + 1) * per_line
        if len(plan) < most and cost <= left:
            plan.append(r | {"tokens": cost})
            left -= cost
    return plan


def edit_plan(regions: Iterable[dict], lines: dict[str, int], budget: int, lead: int = 12, trail: int = 4, header: int = 40, whole: int = 400, per_line: int = 10) -> list[dict]:
    """Regions widened for editing: short files whole, else the head of the file and padded spans, merged where close."""
    wide: dict[str, list[tuple[int, int]]] = {}
    for r in regions:
        size = lines.get(r["path"], r["end"])
        spans = wide.setdefault(r["path"], [(1, size)] if size <= whole else [(1, min(header, size))])
        if size > whole:
            spans.append((max(1, r["start"] - lead), min(size, r["end"] + trail)))
    merged = []
    for path, spans in wide.items():
        out: list[list[int]] = []
        for a, b in sorted(spans):
            if out and a - out[-1][1] <= lead:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        merged += [{"path": path, "start": a, "end": b} for a, b in out]
    return reading_plan(merged, budget, most=len(merged), per_line=per_line)


def merge_regions(spans: DataFrame, keys: list[str], start: str, end: str, gap: int = 12, chunks: int = 1024) -> DataFrame:
    """Spans of each key that overlap or lie within ``gap`` of each other become one.

    The range of all starts is cut into ``chunks``; spans are put in order within a chunk, and what a
    chunk hands on (how far the spans before it reach, how many regions began) comes from one row
    for each key and chunk. So a key of a large share of all spans is no task of its own. Null keys are a key.
    """
    edge = spans.agg(F.min(start).alias("__low"), F.max(start).alias("__high"))
    width = F.greatest(F.ceil((F.col("__high") - F.col("__low") + 1) / chunks), F.lit(1))
    parts = spans.select(*keys, start, end).crossJoin(F.broadcast(edge)).withColumn("__chunk", F.floor((F.col(start) - F.col("__low")) / width)).drop("__low", "__high")
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(start, end)

    def handed(rows: DataFrame, value, name: str) -> DataFrame:
        """rows with the running ``value`` of the chunks before theirs."""
        each = rows.groupBy(*keys, "__chunk").agg(value.alias("__v"))
        over = F.max("__v") if name == "__reached" else F.sum("__v")
        each = each.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__c"), over.over(before).alias(name))
        match = F.col("__chunk") == F.col("__c")
        for i, k in enumerate(keys):
            match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return rows.join(each, match).drop("__c", *[f"__k{i}" for i in range(len(keys))])

    reached = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reached"))
    flagged = handed(parts, F.max(end), "__reached").withColumn("__new", F.when(F.col(start) - reached <= gap, 0).otherwise(1))
    numbered = handed(flagged, F.sum("__new"), "__began").withColumn("__island", F.coalesce("__began", F.lit(0)) + F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans")).drop("__island")


def without(candidates: DataFrame, exclude: list[str]) -> DataFrame:
    """Candidates outside the excluded paths; those without a path stay."""
    return candidates.where(F.col("path").isNull() | ~F.col("path").isin(exclude)) if exclude else candidates
