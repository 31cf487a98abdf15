"""Repetition inside a document: cheap statistics, an isolation forest over them, an exact check.

The statistics of a text are shares of it that repeat earlier parts (short runs of words,
sentences, lines, paragraphs). An isolation forest fitted on a bounded sample of ordinary
rows turns them into a score from path lengths over random splits; the threshold is
calibrated on the labelled rows of the sample that the forest has not seen. What lies above
it goes to the exact check, and so does every text whose share may still reach the limit:
runs of three words that stood earlier cover at least what runs of six do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import parallel, pick

#: Words in a run that counts as repeated, and letters of a script without word spaces that stand for it.
RUN_WORDS, RUN_LETTERS = 6, 20
#: Words of the short runs whose share bounds that of the full runs from above.
SHORT_WORDS = 3
STATISTICS = ["short_share", "repeat_sentence_share", "repeat_line_share", "repeat_paragraph_share", "top2_share", "word_variety_loss"]
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_ASCII_WORD = re.compile(r"[a-z]+")
_UNSPACED = regex.compile(r"\p{Thai}")
_LETTER = regex.compile(r"\p{L}")
_SENTENCE = re.compile(r"[.!?;\n]+")
#: Texts with more units than this are compared by sorted number arrays instead of dictionaries.
LARGE = 20_000


def units(text: str) -> tuple[list[str], list[str]]:
    """The words of a text in lower case, and the letters of its stretches in an unspaced script."""
    low = text.lower()
    found = _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
    if low.isascii() or not _UNSPACED.search(low):
        return found, []
    words: list[str] = []
    letters: list[str] = []
    for w in found:
        if _UNSPACED.search(w):
            letters += _LETTER.findall(w)
        else:
            words.append(w)
    return words, letters


def repeated(sequence: list[str], n: int) -> int:
    """Members of the sequence that lie in a run of n which stood earlier in it."""
    length = len(sequence) - n + 1
    if length < 2:
        return 0
    if len(sequence) > LARGE:
        return _repeated_large(sequence, n)
    seen = set()
    marked = reached = 0
    for i, run in enumerate(zip(*[sequence[k:] for k in range(n)])):
        if run in seen:
            marked += i + n - max(i, reached)
            reached = i + n
        else:
            seen.add(run)
    return marked


def _repeated_large(sequence: list[str], n: int) -> int:
    """The same by doubling: the number of a run of a + b is that of its (run of a, run of b)."""
    number: dict[str, int] = {}
    single = np.fromiter((number.setdefault(w, len(number)) for w in sequence), np.int64, len(sequence))

    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)

    runs, size = single, 1
    while size < n:
        step = min(size, n - size)
        runs = join(runs[: len(runs) - step], runs[step:]) if step == size else join(runs[: len(single) - size - step + 1], single_runs(single, step, join)[size : size + len(single) - size - step + 1])
        size += step
    first = np.full(int(runs.max()) + 1, len(runs), np.int64)
    np.minimum.at(first, runs, np.arange(len(runs)))
    again = np.flatnonzero(first[runs] < np.arange(len(runs)))
    edge = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def single_runs(single: np.ndarray, n: int, join) -> np.ndarray:
    runs = single
    for k in range(1, n):
        runs = join(runs[: len(single) - k], single[k:])
    return runs


def _repeated_parts(parts: list[str], total: int) -> float:
    seen: set[str] = set()
    again = 0
    for p in parts:
        p = p.strip()
        if p:
            if p in seen:
                again += len(p)
            seen.add(p)
    return again / total if total else 0.0


def _top_share(words: list[str], n: int, total: int) -> float:
    if len(words) < 2 * n or not total:
        return 0.0
    run, count = Counter(zip(*[words[k:] for k in range(n)])).most_common(1)[0]
    return min(1.0, count * sum(map(len, run)) / total) if count > 1 else 0.0


def run_share(words: list[str], letters: list[str], n: int) -> float:
    """The share of a text that stands in runs of n words (or as many letters as stand for them) that stood earlier."""
    weight = RUN_WORDS / RUN_LETTERS
    size = len(words) + weight * len(letters)
    return (repeated(words, n) + weight * repeated(letters, round(n / weight))) / size if size else 0.0


def repeat_share(text: str | None) -> float:
    """The exact share of a text that repeats earlier runs of it; 0 for null, empty and wordless texts."""
    return run_share(*units(text), RUN_WORDS) if text else 0.0


def statistics(text: str | None, words: list[str], letters: list[str]) -> list[float]:
    """The statistics of one text, each in [0, 1], from its units; all 0 for null, empty and wordless texts."""
    if not text or not (words or letters):
        return [0.0] * len(STATISTICS)
    return [
        run_share(words, letters, SHORT_WORDS),
        _repeated_parts(_SENTENCE.split(text), len(text)),
        _repeated_parts(text.splitlines(), len(text)),
        _repeated_parts(text.replace("\r\n", "\n").split("\n\n"), len(text)),
        _top_share(words, 2, sum(map(len, words))),
        1 - len(set(words)) / len(words) if words else 0.0,
    ]


def _average_path(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits; rows that few splits isolate score near 1."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(rows: np.ndarray, limit: int, rng) -> tuple[np.ndarray, ...]:
        feature, cut_at, low, high, path = [], [], [], [], []

        def node(own: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column in (feature, cut_at, low, high, path):
                column.append(-1)
            spread = own.max(0) - own.min(0) if len(own) else np.zeros(rows.shape[1])
            choices = np.flatnonzero(spread > 0)
            if depth >= limit or len(own) <= 1 or not len(choices):
                path[at] = depth + _average_path(len(own))
                return at
            f = int(rng.choice(choices))
            feature[at], cut_at[at] = f, own[:, f].min() + rng.random() * spread[f]
            below = own[:, f] < cut_at[at]
            low[at], high[at] = node(own[below], depth + 1), node(own[~below], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(cut_at, float), np.array(low), np.array(high), np.array(path, float)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut_at, low, high, path in self.trees:
            at = np.zeros(len(rows), int)
            while len(inner := np.flatnonzero(feature[at] >= 0)):
                here = at[inner]
                at[inner] = np.where(rows[inner, feature[here]] < cut_at[here], low[here], high[here])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_average_path(self.size), 1e-9))


def calibrate(forest: IsolationForest, rows: np.ndarray, labels: np.ndarray) -> float:
    """A threshold under every labelled case: halfway from their least score to the median of the rest."""
    if not labels.any():
        return 0.0
    scores = forest.score(rows)
    least = scores[labels].min()
    rest = np.median(scores[~labels]) if (~labels).any() else 0.0
    return float(least - max(0.0, least - rest) / 2)


#: Rows a forest is fitted and calibrated on at most; twice as many where a hash spreads them unevenly.
FIT_ROWS = 5000
#: Share of a text that must repeat for it to be a case.
CASE_SHARE = 0.4
_SAMPLE_PARTS = 1 << 20


def fit(documents: DataFrame, text_column: str = "text", share: float = CASE_SHARE, fit_rows: int = FIT_ROWS, trees: int = 100, seed: int = 7) -> tuple[IsolationForest | None, float]:
    """(forest, threshold) from about ``fit_rows`` rows, taken evenly by a hash of their text.

    The rows are labelled by the definition. The forest grows on ordinary rows of one half,
    the threshold lies under every case of the other half and of its own. Without ordinary
    rows there is no forest, without cases the threshold is 0: then every row is above it.
    """
    rows = pick(documents, __text=text_column).where("__text is not null")
    parts = F.pmod(F.xxhash64("__text"), F.lit(_SAMPLE_PARTS))
    kept = parts < F.lit(min(_SAMPLE_PARTS, -(-fit_rows * _SAMPLE_PARTS // max(1, rows.count()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                own = units(t)
                found.append([*statistics(t, *own), run_share(*own, RUN_WORDS)])
            table = np.array(found, float).reshape(-1, len(STATISTICS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(table.shape[1])], [*STATISTICS, "share"])

    labelled = rows.where(kept).limit(2 * fit_rows).mapInArrow(run, ", ".join(f"{c} double" for c in [*STATISTICS, "share"]))
    table = np.array([tuple(r) for r in labelled.collect()], float).reshape(-1, len(STATISTICS) + 1)  # 2 * fit_rows rows of numbers
    table = table[np.lexsort(table.T)]
    cases = table[:, -1] >= share
    seen = np.arange(len(table)) % 2 == 0
    if not (seen & ~cases).any():
        return None, 0.0
    forest = IsolationForest(table[seen & ~cases][:, :-1], trees=trees, seed=seed)
    held = ~seen | cases
    return forest, calibrate(forest, table[held][:, :-1], cases[held])


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = CASE_SHARE, fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """(id, statistics..., score, above, possible, repeat_share) of every row, over its whole text.

    ``above`` is the forest's word: score at or over the threshold. ``possible`` says that the
    short runs do not rule out a share of ``share``. ``repeat_share`` is exact for rows that are
    either, and null for the others, whose share is under ``share`` for certain. Null, empty and
    wordless texts repeat nothing. Repeated rows come out repeated, an empty input stays empty.
    """
    forest, threshold = fit(documents, text_column, share, fit_rows, seed=seed)
    rows = parallel(pick(documents, **{id_column: id_column, "__text": text_column}))
    kind = rows.schema[id_column].dataType.simpleString()
    names = [id_column, *STATISTICS, "score", "above", "possible", "repeat_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [units(t) if t else ([], []) for t in texts]
            table = np.array([statistics(t, *u) for t, u in zip(texts, own)], float).reshape(-1, len(STATISTICS))
            scores = forest.score(table) if forest else np.ones(len(table))
            above, possible = scores >= threshold, table[:, 0] >= share
            exact = [run_share(*u, RUN_WORDS) if a or p else None for u, a, p in zip(own, above, possible)]
            columns = [batch.column(0), *(pa.array(table[:, k]) for k in range(table.shape[1])), pa.array(scores), pa.array(above), pa.array(possible), pa.array(exact, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"{c} double" for c in [*STATISTICS, "score"])
    return rows.mapInArrow(run, f"`{id_column}` {kind}, {fields}, above boolean, possible boolean, repeat_share double")


def found(documents: DataFrame, share: float = CASE_SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id) of the texts of whose words ``share`` or more repeat earlier runs; repeated rows come out repeated."""
    return judge(documents, share=share, fit_rows=fit_rows).where((F.col("above") | F.col("possible")) & (F.col("repeat_share") >= share)).select("doc_id")


def recall(documents: DataFrame, share: float = CASE_SHARE) -> DataFrame:
    """One row: texts, cases, above (rows over the forest's threshold), above_cases and forest_recall over the whole input."""
    judged = judge(documents, share=share).withColumn("case", F.coalesce(F.col("repeat_share") >= share, F.lit(False)))
    counted = judged.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("case").alias("cases"), F.count_if("above").alias("above"), F.count_if(F.col("case") & F.col("above")).alias("above_cases")
    )
    return counted.withColumn("forest_recall", F.when(F.col("cases") > 0, F.round(F.col("above_cases") / F.col("cases"), 6)))
