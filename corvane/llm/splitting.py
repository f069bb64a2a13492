"""Oversized texts into overlapping pieces, by recursive bisection at natural boundaries.

Cuts are only made before white space (or, in a run without any, between pieces of the
tokenizer's pattern), where the tokens on both sides are those of the whole text; so running
sums of token counts give the exact size of every span. A span that is too large is cut at the
strongest boundary around its middle, and both halves again; overlaps are attached at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import _SPACES, ByteBPE, bpe, count_array, vocabulary_path

_WORD = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_STOP = tuple(".!?…。！？")
_CLOSING = "\"'”’»)]"
_ENDING = frozenset((*_STOP, *_CLOSING))
_BLANKS = frozenset(_SPACES)
# Strength of a boundary.
PARAGRAPH, LINE, SENTENCE, WORD, PIECE, INSIDE = 5, 4, 3, 2, 1, 0
KINDS = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", PIECE: "piece", INSIDE: "inside"}

SURELY_LONG = 8  # characters a token, above which a text is split without counting its tokens first
SCHEMA_TAIL = "piece int, start int, end int, overlap_tokens int, n_tokens int, cut string, text string"


def _strength(gap: str, before: str) -> int:
    """Of a cut at white space ``gap`` after the word ``before``."""
    lines = len(_LINE.findall(gap))
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    return SENTENCE if before.rstrip(_CLOSING).endswith(_STOP) else WORD


def _boundaries(text: str, b: ByteBPE, inner: int) -> tuple[list[int], list[int], list[int]]:
    """Places where ``text`` may be cut (with both ends), tokens before each, strength of each.

    Words of more than ``inner`` tokens have places inside, too.
    """
    words = _WORD.findall(text)
    bare, spaced, bounds = b.bare, b.spaced, b._bounds
    at, cum, strength = [0], [0], [PARAGRAPH]
    n = pos = 0
    last = ""  # character before the word
    for i, word in enumerate(words):
        plain = word[0] == " " and word[1:2] not in _BLANKS
        if i:
            at.append(pos)
            cum.append(n)
            if plain and last not in _ENDING:
                strength.append(WORD)
            else:
                strength.append(_strength(word[: len(word) - len(word.lstrip(_SPACES))], words[i - 1]))
        k = spaced[word[1:]] if plain else bare[word]
        size = bounds[k + 1] - bounds[k]
        if size > inner:
            _inside(word, pos, n, inner, b, at, cum, strength)
        n += size
        pos += len(word)
        last = word[-1]
    at.append(len(text))
    cum.append(n)
    strength.append(PARAGRAPH)
    return at, cum, strength


def _inside(word: str, start: int, n: int, inner: int, b: ByteBPE, at: list[int], cum: list[int], strength: list[int]) -> None:
    """Add the places inside a long word: between pieces of the pattern, and within pieces that are long themselves."""
    pos = start
    before = ""
    for p in b.pattern.findall(word):
        if pos > start:
            at.append(pos)
            cum.append(n)
            # next to white space a cut may change tokens, as inside a piece
            strength.append(INSIDE if p[0].isspace() or before[-1].isspace() else PIECE)
        tokens = b.merge(p.encode("utf-8", "replace"))
        if len(tokens) > inner:
            ends = np.cumsum([len(b.symbols[i]) for i in tokens])
            chars = np.cumsum([len(c.encode("utf-8", "replace")) for c in p])
            whole = np.isin(ends, chars)
            where = np.searchsorted(chars, ends[whole]) + 1
            for c, t in zip(where[:-1].tolist(), (np.flatnonzero(whole) + 1)[:-1].tolist(), strict=True):
                at.append(pos + c)
                cum.append(n + t)
                strength.append(INSIDE)
        n += len(tokens)
        pos += len(p)
        before = p


def split_text(text: str, limit: int, overlap: int, b: ByteBPE) -> list[tuple[int, int, int, int, int, int]]:
    """(begin, start, end, overlap tokens, tokens, strength of the cut at the start) of each piece, in order.

    ``start`` is where the piece's own text begins, ``begin`` where its overlap does.
    """
    room = limit - overlap
    at, cum, strength = _boundaries(text, b, min(room, overlap or room))
    last = len(at) - 1
    if cum[last] <= limit:
        return [(0, 0, len(text), 0, cum[last], PARAGRAPH)]
    strong, tokens = np.asarray(strength), np.asarray(cum)
    cuts: list[int] = []
    todo = [(0, last)]
    while todo:
        lo, hi = todo.pop()
        size = cum[hi] - cum[lo]
        if size <= room or hi - lo < 2:
            continue
        mid = cum[lo] + size / 2
        near = size / 4
        left = max(lo + 1, bisect_left(cum, mid - near, lo + 1, hi))
        right = min(hi - 1, bisect_right(cum, mid + near, lo + 1, hi) - 1)
        if left > right:  # none around the middle: the nearest on either side
            left = max(lo + 1, min(left, hi - 1) - 1)
            right = min(hi - 1, left + 1)
        near_by = strong[left : right + 1]
        strongest = np.flatnonzero(near_by == near_by.max()) + left
        best = int(strongest[np.argmin(np.abs(tokens[strongest] - mid))])
        cuts.append(best)
        todo += [(lo, best), (best, hi)]
    cuts = [0, *sorted(cuts), last]
    out = []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        back = bisect_left(cum, cum[lo] - overlap, 0, lo) if k else lo
        out.append((at[lo], at[hi], at[back], cum[lo] - cum[back], cum[hi] - cum[back], strength[lo], strength[back]))
    pieces = []
    for start, end, begin, shared, size, kind, kind_back in out:
        if size > limit or INSIDE in (kind, kind_back) or end < len(text) and strength[bisect_left(at, end)] == INSIDE:
            # a cut inside a piece of the pattern may change the tokens next to it: measure
            shared = len(b.encode(text[begin:start]))
            size = len(b.encode(text[begin:end]))
            while size > limit and begin < start:
                begin = min(start, begin + max(1, (size - limit) // 4))  # a character has four tokens at most
                shared, size = len(b.encode(text[begin:start])), len(b.encode(text[begin:end]))
            while size > limit:  # as rare as can be: halve it
                half = (start + end) // 2
                pieces.append((begin, start, half, shared, len(b.encode(text[begin:half])), kind))
                begin, start, kind = max(start, half - overlap), half, INSIDE
                shared = len(b.encode(text[begin:start]))
                while shared > overlap:
                    begin = min(start, begin + max(1, (shared - overlap) // 4))
                    shared = len(b.encode(text[begin:start]))
                size = len(b.encode(text[begin:end]))
        pieces.append((begin, start, end, shared, size, kind))
    return pieces


def split_oversized(
    df: DataFrame, limit: int, overlap: int, text: str = "text", ident: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """Pieces of at most ``limit`` tokens: ``ident``, piece (from 0), start, end, overlap_tokens, n_tokens, cut, text.

    A text within the limit is one piece. Otherwise consecutive pieces share up to ``overlap`` tokens (as many
    as reach back to a boundary, which in a word of more tokens than that lies inside the word); ``start`` and ``end`` (in characters) are the piece without its overlap, so
    that the texts between them, joined, are the whole text. ``cut`` names the boundary at ``start``. An empty
    text is one empty piece, a null text none. Repeated rows give repeated pieces; other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    path = vocabulary_path(vocabulary)
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            texts = batch.column(1)
            long = pc.greater(pc.utf8_length(texts), SURELY_LONG * limit)  # no need to count these, which splitting does
            sizes = count_array(pc.if_else(long, None, texts), path).tolist()
            row: list[int] = []
            cols: list[list] = [[] for _ in range(7)]
            for k, t in enumerate(texts.to_pylist()):
                if t is None:
                    continue
                if sizes[k] <= limit and len(t) <= SURELY_LONG * limit:
                    pieces = [(0, 0, len(t), 0, sizes[k], PARAGRAPH)]
                else:
                    pieces = split_text(t, limit, overlap, b)
                for no, (begin, start, end, shared, size, strength) in enumerate(pieces):
                    row.append(k)
                    name = KINDS[strength] if no else "start"
                    for c, v in zip(cols, (no, start, end, shared, size, name, t[begin:end]), strict=True):
                        c.append(v)
            types = [pa.int32()] * 5 + [pa.string()] * 2
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, x) for c, x in zip(cols, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [ident, "piece", "start", "end", "overlap_tokens", "n_tokens", "cut", "text"])

    return df.select(F.col(ident), F.col(text).cast("string")).mapInArrow(run, f"{ident} {kind}, {SCHEMA_TAIL}")
