"""Encoding with a public byte-level BPE tokenizer.

Each pre-token is a doubly linked list of byte symbols. A priority queue holds the
adjacent pairs that can merge, by (rank, position); a popped entry whose symbols have
changed since is stale and skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import pick

DEFAULT_FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Pre-tokens whose ids a worker remembers; beyond it the memory is emptied, results do not change.
REMEMBERED = 200_000
#: Longer pre-tokens are not remembered.
REMEMBERED_LENGTH = 64

# The pattern that cuts a text into pre-tokens in byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary strings."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class ByteBpe:
    """Encoder and decoder over a vocabulary and a ranked list of merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_alphabet()
        self._byte_ids = [vocabulary[letters[b]] for b in range(256)]
        self._ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self._strings = {i: s for s, i in vocabulary.items()}
        self._bytes = {c: b for b, c in letters.items()}
        self._cut = regex.compile(PATTERN)
        self._known: dict[str, list[int]] = {}

    @classmethod
    def from_json(cls, text: str) -> ByteBpe:
        """From the text of a tokenizer file with ``model.vocab`` and ``model.merges``."""
        model = json.loads(text)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges)

    def _merge(self, data: bytes) -> list[int]:
        symbols: list[int] = [self._byte_ids[b] for b in data]
        n = len(symbols)
        if n == 1:
            return symbols
        ranks = self._ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(hit[0], i, a, b, hit[1]) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (hit := ranks.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # stale: one of the two has merged meanwhile
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if hit := ranks.get((merged, symbols[k])):
                    heapq.heappush(queue, (hit[0], i, merged, symbols[k], hit[1]))
            if (h := before[i]) >= 0 and (hit := ranks.get((symbols[h], merged))):
                heapq.heappush(queue, (hit[0], h, symbols[h], merged, hit[1]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text here; null and empty give []."""
        if not text:
            return []
        ids: list[int] = []
        known = self._known
        for piece in self._cut.findall(text):
            own = known.get(piece)
            if own is None:
                own = self._merge(piece.encode("utf-8", "replace"))
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = own
            ids += own
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return bytes(self._bytes[c] for i in ids for c in self._strings[i]).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def _worker_encoder(shared) -> ByteBpe:
    """One encoder for each worker process and tokenizer file."""
    text = shared.value
    key = f"{len(text)}:{hash(text)}"
    if key not in _loaded:
        _loaded[key] = ByteBpe.from_json(text)
    return _loaded[key]


def _broadcast(df: DataFrame, tokenizer: str, folder: str):
    """The tokenizer file as text, read by the driver: a fixed file of under 2 MB."""
    with open(os.path.join(folder, f"{tokenizer}.json"), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _map_text(df: DataFrame, keep: list[str], source: str, out: str, kind: str, tokenizer: str, folder: str, apply: Callable) -> DataFrame:
    """The kept columns, unchanged, and ``out``: ``apply(encoder, value)`` of every row's source column."""
    rows = pick(df, **{c: c for c in keep}, __source=source)
    shared = _broadcast(df, tokenizer, folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}, `{out}` {kind}"
    arrow = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_encoder(shared)
        for batch in batches:
            made = pa.array([apply(bpe, v) for v in batch.column(len(keep)).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*keep, out])

    return rows.mapInArrow(run, schema)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(id, ids): the token ids of every row, repeated rows included; null and empty texts give an empty list."""
    return _map_text(documents, [id_column], text_column, "ids", "array<int>", tokenizer, folder, lambda bpe, v: bpe.encode(v))


def token_counts(documents: DataFrame, keep: list[str], text_column: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The kept columns and ``tokens``, the number of ids of the text (0 for null and empty)."""
    return _map_text(documents, keep, text_column, "tokens", "long", tokenizer, folder, lambda bpe, v: len(bpe.encode(v)))


def decode(encoded: DataFrame, id_column: str = "doc_id", tokenizer: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(id, text) from (id, ids); null ids give null."""
    return _map_text(encoded, [id_column], "ids", "text", "string", tokenizer, folder, lambda bpe, v: None if v is None else bpe.decode(v))
