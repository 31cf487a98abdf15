"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a stream of tokens: its documents in a shuffled order, shuffled anew for
each repetition, cut into blocks of equal token counts. Golden-ratio points mapped through
the cumulative weights give each slot of the mixture a source; the rank of a slot among
those of its source is the block it takes. Any prefix of the mixture thus holds the sources
in nearly their final shares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm import bpe
from quarrylens.runtime import cut, pick

BLOCK_TOKENS = 256
#: A mixture is planned on the driver from one row for each target; more targets are refused.
MAX_SOURCES = 10_000
#: Slots that are ranked together, and documents that are put in order together.
CHUNK_SLOTS, CHUNK_DOCUMENTS = 65_536, 20_000
#: Points are whole numbers under 2 to the BITS: multiples of the golden ratio of that range, modulo the range.
BITS, CELL_BITS = 62, 16
_HALF = (1 << BITS // 2) - 1
GOLDEN = (math.isqrt(5 << 2 * BITS) - (1 << BITS)) // 2 | 1


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, ``-`` for blanks and ``_``."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s_\-]+", "-")


def plan(targets: dict[str, tuple[float, int | None]], sizes: dict[str, int], total: int | None = None) -> dict[str, dict]:
    """Tokens that each source gives: its share of the total, at most its cap times its size.

    Shares are scaled to sum to one over the sources that have documents. What capped
    sources cannot give, the others give in proportion to their shares; if all are capped
    the mixture is smaller than ``total`` (by default the size of all mixed sources).
    """
    live = {s: (w, cap) for s, (w, cap) in targets.items() if w and w > 0 and sizes.get(s, 0) > 0 and (cap is None or cap > 0)}
    weight = sum(w for w, _ in live.values())
    total = sum(sizes[s] for s in live) if total is None else total
    amounts: dict[str, int] = {}
    open_, left = dict(live), float(total)
    while open_:
        open_weight = sum(w for w, _ in open_.values())
        full = {s for s, (w, cap) in open_.items() if cap is not None and left * w / open_weight >= cap * sizes[s]}
        if not full:
            amounts |= {s: round(left * w / open_weight) for s, (w, _) in open_.items()}
            break
        for s in full:
            amounts[s] = open_.pop(s)[1] * sizes[s]
            left -= amounts[s]
    return {
        s: {"target": live[s][0] / weight, "size": sizes[s], "amount": a, "capped": live[s][1] is not None and a >= live[s][1] * sizes[s]}
        for s, a in sorted(amounts.items()) if a > 0
    }


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int | None]]:
    """Shares by source name; targets of one name in several spellings add up, their least cap holds."""
    rows = pick(mix_targets, "source", "target_share", "max_repeats").where("source is not null and target_share > 0 and not isnan(target_share)")
    rows = rows.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("cap"))
    found = rows.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} mixture targets")
    return {r.source: (float(r.w), None if r.cap is None else int(r.cap)) for r in found}


def point(slot: Column) -> Column:
    """``slot * GOLDEN`` modulo 2 to the BITS, exact for slots below 2 to the BITS, by halves that never overflow."""
    low, high = slot.bitwiseAND(F.lit(_HALF)), F.shiftright(slot, BITS // 2)
    g_low, g_high = F.lit(GOLDEN & _HALF), F.lit(GOLDEN >> BITS // 2)
    upper = (high * g_low).bitwiseAND(F.lit(_HALF)) + (low * g_high).bitwiseAND(F.lit(_HALF))
    return (low * g_low + F.shiftleft(upper.bitwiseAND(F.lit(_HALF)), BITS // 2)).bitwiseAND(F.lit((1 << BITS) - 1))


def schedule(spark, slots: dict[str, int]) -> DataFrame:
    """(slot, source, block): each source's blocks 0..n-1, each once, spread evenly over the slots.

    The points give a source its number of slots but for a few: as the golden ratio has the
    least partial quotients of all, a stretch of n points is off by at most 3 + log2(n). The
    slots a source has too many take the blocks others have left over; that many rows for
    each source at most are broadcast, which is checked.
    """
    names, total = sorted(slots), sum(slots.values())
    if not total:
        return spark.createDataFrame([], "slot long, source string, block long")
    cells, reached, shift = [], 0, BITS - CELL_BITS
    for n in names:
        low, high = (reached << BITS) // total, (reached + slots[n] << BITS) // total
        reached += slots[n]
        cells += [(cell, n, low, high) for cell in range(low >> shift, (high - 1 >> shift) + 1)]
    ranges = F.broadcast(spark.createDataFrame(cells, "cell long, source string, low long, high long"))  # 2 ** CELL_BITS rows and one for each source
    drawn = (
        spark.range(total)
        .select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("u"), F.floor(F.col("id") / CHUNK_SLOTS).alias("chunk"))
        .withColumn("cell", F.shiftright("u", shift))
        .join(ranges, "cell")
        .where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        .select("slot", "chunk", "source")
    )
    chunks = drawn.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = chunks.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = drawn.join(before, ["source", "chunk"]).select("slot", "source", (F.col("before") + rank).cast("long").alias("block"))
    got = {r.source: r.n for r in chunks.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row for each target
    over = [(n, b) for n in names for b in range(slots[n], got.get(n, 0))]
    under = [(n, b) for n in names for b in range(got.get(n, 0), slots[n])]
    if len(over) > len(names) * (3 + total.bit_length()):
        raise AssertionError(f"{len(over)} slots beyond the bound of the sequence")
    if not over:
        return ranked
    swaps = F.broadcast(spark.createDataFrame([(*o, *u) for o, u in zip(over, under)], "source string, block long, to_source string, to_block long"))
    return ranked.join(swaps, ["source", "block"], "left").select(
        "slot", F.coalesce("to_source", "source").alias("source"), F.coalesce("to_block", "block").alias("block")
    )


def streams(sized: DataFrame, amounts: dict[str, dict], seed: int) -> DataFrame:
    """(source, epoch, doc_id, start, tokens): where each document lies in its source's stream.

    Places are sums over shuffle order, first within runs of the order and then over the
    runs, so the largest source needs no task of its own.
    """
    spark = sized.sparkSession
    rows = [(s, p["size"], p["amount"], -(-p["amount"] // p["size"])) for s, p in amounts.items()]
    sources = F.broadcast(spark.createDataFrame(rows, "source string, size long, amount long, epochs long"))
    count = sized.count()
    runs = max(1, -(-count // CHUNK_DOCUMENTS))
    placed = (
        sized.join(sources, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
        .withColumn("h", F.xxhash64("doc_id", "copy", "epoch", F.lit(seed)))
        .withColumn("run", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * runs))
    )
    sums = placed.groupBy("source", "epoch", "run").agg(F.sum("tokens").alias("n"))
    offset = sums.select("source", "epoch", "run", (F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("run")) - F.col("n")).alias("offset"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "epoch", "run").orderBy("h", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0))
    start = F.col("epoch") * F.col("size") + F.col("offset") + inside - F.col("tokens")
    return placed.join(offset, ["source", "epoch", "run"]).select("source", "epoch", "doc_id", "copy", start.alias("start"), "tokens", "amount")


def _sized(documents: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """(source, doc_id, copy, tokens) of the rows with tokens and a source; ``copy`` numbers the rows of one id."""
    rows = bpe.token_counts(documents, ["doc_id", "source"], "text", tokenizer, folder)
    rows = rows.where("tokens > 0 and source is not null").select(source_name(F.col("source")).alias("source"), "doc_id", "tokens")
    grouped = rows.groupBy("source", "doc_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def _planned(documents: DataFrame, mix_targets: DataFrame, total: int | None, tokenizer: str, folder: str) -> tuple[DataFrame, dict[str, dict]]:
    targets = _targets(mix_targets)
    sized = cut(_sized(documents, tokenizer, folder).where(F.col("source").isin(list(targets))) if targets else _sized(documents, tokenizer, folder).where("false"))
    sizes = {r.source: int(r.n) for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row for each target
    return sized, plan(targets, sizes, total)


MIX = "slot long, part int, source string, epoch long, doc_id long, token_from long, token_to long"


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, seed: int = 11,
        tokenizer: str = bpe.DEFAULT_TOKENIZER, folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """The mixture: for each slot the parts of documents that fill its block.

    Out: slot, part (place in the slot), source, epoch (0 for the first use), doc_id and
    the range of its tokens. Every block has ``block`` tokens but the last of a source.
    Documents without tokens or source, and sources without a positive share, give
    nothing; without any the result is empty. Repeated rows are documents of their own.
    """
    spark = documents.sparkSession
    sized, amounts = _planned(documents, mix_targets, total, tokenizer, folder)
    if not amounts:
        kind = sized.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], MIX.replace("doc_id long", f"doc_id {kind}"))
    places = streams(sized, amounts, seed).where(F.col("start") < F.col("amount"))
    end = F.least(F.col("start") + F.col("tokens"), F.col("amount"))
    parts = places.withColumn("end", end).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    first, last = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    parts = parts.select("source", "block", "epoch", "doc_id", first.alias("at"), (first - F.col("start")).alias("token_from"), (last - F.col("start")).alias("token_to"))
    slots = schedule(spark, {s: -(-p["amount"] // block) for s, p in amounts.items()})
    order = Window.partitionBy("slot").orderBy("at")
    return parts.join(slots, ["source", "block"]).select("slot", F.row_number().over(order).alias("part"), "source", "epoch", "doc_id", "token_from", "token_to")


def shares(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, seed: int = 11,
           tokenizer: str = bpe.DEFAULT_TOKENIZER, folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """What the mixture reaches: for each mixed source target_share, actual_share, tokens, available, repeats and capped."""
    spark = documents.sparkSession
    _, amounts = _planned(documents, mix_targets, total, tokenizer, folder)
    whole = sum(p["amount"] for p in amounts.values())
    rows = [(s, p["target"], p["amount"] / whole, p["amount"], p["size"], p["amount"] / p["size"], p["capped"]) for s, p in amounts.items()]
    return spark.createDataFrame(rows, "source string, target_share double, actual_share double, tokens long, available long, repeats double, capped boolean")
