"""Byte-level BPE over a public vocabulary, and token ids of a whole column.

A piece of text starts as a doubly linked list of byte symbols. All mergeable neighbours wait in
a priority queue by merge rank, then place; a popped entry whose symbols have changed since is
stale and skipped. So a piece of n bytes costs O(n log n), a run without any boundary too.

Texts are cut at single spaces first: no piece of the pattern runs from a non-space into a
space, so every such cut is a cut of the pattern, and the ids of the few distinct words are
worked out once per worker and kept in a bounded memo.
"""

from __future__ import annotations

import base64
import heapq
import importlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as Unicode has it, for the cuts of the slow path.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(r"\s ")
MEMO = 300_000  # words kept per worker
MEMO_CHARS = 64  # longer words are worked out anew


def vocabulary_path(name: str) -> str:
    """The file of a public vocabulary; a path is returned as it is."""
    if "/" in name:
        return name
    return importlib.import_module("public_tokenizers").path(name)


def _pattern() -> str:
    return importlib.import_module("public_tokenizers").PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies in JSON use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Symbol to id; in these vocabularies the id is also the order of the merge."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        return {bytes(letters[c] for c in s): i for s, i in vocab.items() if all(c in letters for c in s)}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        self.ranks = load_ranks(path)
        self.symbols = {i: s for s, i in self.ranks.items()}
        self.pattern = regex.compile(pattern or _pattern())
        self._pieces: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        """Empty the pool and the memos that point into it."""
        self.bare, self.spaced = _Memo(self, ""), _Memo(self, " ")
        self._ids: list[int] = []
        self._bounds = [0]

    def pool_add(self, ids: list[int]) -> int:
        self._ids += ids
        self._bounds.append(len(self._ids))
        return len(self._bounds) - 2

    def pool(self) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(self._ids, np.int32), np.asarray(self._bounds, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        n = len(piece)
        if n == 1:
            return [ranks[piece]]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))  # a symbol is piece[i:end[i]]; 0 marks one merged away
        queue = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = right[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # stale
            end[i], end[j] = stop, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = ranks.get(piece[i : end[k]])
                if r is not None:
                    heapq.heappush(queue, (r, i, end[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    heapq.heappush(queue, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; nothing in it is special."""
        ids, bounds = self._ids, self._bounds
        return [i for k in self.codes(text) for i in ids[bounds[k] : bounds[k + 1]]]

    def codes(self, text: str) -> list[int]:
        """The rows of the pool that spell ``text``."""
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and not _RUN.search(text):
            parts = text.split(" ")
            out = [self.bare[parts[0]]]
            out += map(self.spaced.__getitem__, parts[1:])
            return out
        return list(map(self.bare.__getitem__, self.words(text)))

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.pattern.findall(word):
            ids = self._pieces.get(p)
            if ids is None:
                ids = self.merge(p.encode("utf-8", "replace"))
                if len(p) <= MEMO_CHARS and len(self._pieces) < MEMO:
                    self._pieces[p] = ids
            out += ids
        return out

    def words(self, text: str) -> list[str]:
        """The text cut before every white space that follows a non-space and reaches a single space."""
        parts = text.split(" ")
        out, run = [], ""  # run: the white space in hand, it starts the next word
        for i, w in enumerate(parts):
            run += " " if i else ""
            core = w.rstrip(_SPACES)
            if core:
                out.append(run + core)
                run = w[len(core) :]
            else:
                run += w
        return [*out, run] if run else out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.symbols.__getitem__, ids)).decode("utf-8", "replace")


class _Memo(dict):
    """Word (without the prefix) to its row in the encoder's pool of ids."""

    def __init__(self, bpe: ByteBPE, prefix: str):
        super().__init__()
        self.bpe, self.prefix = bpe, prefix

    def __missing__(self, word: str) -> int:
        at = self.bpe.pool_add(self.bpe.encode_word(self.prefix + word))
        if len(word) <= MEMO_CHARS:
            self[word] = at
        return at


@lru_cache(maxsize=4)
def bpe(path: str) -> ByteBPE:
    """The encoder of ``path``, one per worker."""
    return ByteBPE(path)


def _coded(texts: pa.Array, b: ByteBPE) -> tuple[np.ndarray, np.ndarray]:
    """Pool rows of all texts, and the bounds of each text among them."""
    if len(b.bare) + len(b.spaced) > MEMO or len(b._ids) > 8 * MEMO:
        b.reset()
    flat: list[int] = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts.to_pylist()):
        if t:
            flat += b.codes(t)
        bounds[k + 1] = len(flat)
    return np.asarray(flat, np.int64), bounds


def encode_array(texts: pa.Array, path: str) -> pa.ListArray:
    """Ids of each text; an empty or null text has an empty list."""
    b = bpe(path)
    codes, text_bounds = _coded(texts, b)
    ids, bounds = b.pool()
    size = bounds[codes + 1] - bounds[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(bounds[codes] - ends[:-1], size)
    return pa.ListArray.from_arrays(pa.array(ends[text_bounds].astype(np.int32)), pa.array(ids[at]))


def count_array(texts: pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text; 0 for an empty or null one."""
    b = bpe(path)
    codes, text_bounds = _coded(texts, b)
    bounds = b.pool()[1]
    ends = np.concatenate([[0], np.cumsum(bounds[codes + 1] - bounds[codes])])
    return np.diff(ends[text_bounds])


def token_ids(df: DataFrame, text: str = "text", id_column: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``id_column`` and ``ids`` of every row, without special tokens.

    Texts whose words look like special tokens are ordinary text; null and empty texts have an
    empty list, white space has ids of its own. Rows keep their number; other columns are not read.
    One narrow stage: no shuffle, no state beyond the memo of a worker.
    """
    path = vocabulary_path(vocabulary)
    schema = df.select(F.col(id_column), F.lit(None).cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encode_array(b.column(1), path)], [id_column, "ids"])

    return df.select(F.col(id_column), F.col(text).cast("string")).mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", id_column: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``id_column`` and ``n_tokens`` (bigint) of every row; 0 for null and empty texts."""
    path = vocabulary_path(vocabulary)
    schema = df.select(F.col(id_column), F.lit(0).cast("bigint").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_array(b.column(1), path), pa.int64())], [id_column, "n_tokens"])

    return df.select(F.col(id_column), F.col(text).cast("string")).mapInArrow(run, schema)
