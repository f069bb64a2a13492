"""The language of each document and of each mixed-in segment, by compression.

A text is cut into sentences, and each is compressed with a raw-content zstandard dictionary of
every language; the smallest result names the language, and a narrow margin to the next rejects it.
The dictionaries are cut from a bounded sample of labelled documents, whose sentences are first
relabelled by their words, so that wrong labels and mixed-in sentences drop out.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ISO 639-1 code, then ISO 639-2 codes, former codes and names of the language.
LANGUAGES = """
ar ara arabic العربية
cs ces cze czech čeština
da dan danish dansk
de deu ger german deutsch
en eng english
es spa spanish español espanol castellano
fi fin finnish suomi
fr fra fre french français francais
he heb iw hebrew
hu hun hungarian magyar
id ind in indonesian bahasa_indonesia bahasa
it ita italian italiano
ja jpn japanese 日本語
ko kor korean 한국어
ms msa may malay bahasa_melayu
nl nld dut dutch nederlands flemish
no nor nb nob norwegian norsk
pl pol polish polski
pt por portuguese português portugues
ru rus russian русский
sv swe swedish svenska
tr tur turkish türkçe
uk ukr ukrainian українська
vi vie vietnamese
zh zho chi chinese 中文
"""
_NAMES = {name: line.split()[0] for line in LANGUAGES.split("\n") if line for name in line.split()}

MIN_WORDS = 6  # words of a sentence that counts
WRAPPED = 40  # a line this long may go on in the next
MARGIN = 3  # bytes by which the best language must beat the next
MARGIN_SHARE = 0.06  # the same as a share of the best size
MEMO = 150_000  # sentences kept per worker
DICTIONARY_BYTES = 32_768

_LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
# Scripts without blanks between words: Thai to Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f\U00020000-\U0003ffff"
_DENSE = re.compile(f"[{_UNSPACED}]")
_DENSE_WORD = 2  # characters that count as one word there
_GAP = re.compile(rf"[。！？｡．][」』”’）)]*\s*|[.!?…][\"'”’»)\]]*;?\s+|[{_LINE_ENDS}][\s{_LINE_ENDS}]*|[|·;]\s+")
_BULLETS = " \t\xa0-*•–—#>().·|"
_LETTERS = re.compile(r"[^\W\d_]+")
_CONTACT = re.compile(r"(?:\S+ dot )*\S*(?:@| @ | ?[\[(]at[\])] ?| at (?=\S+ dot ))\S+(?:(?: dot | ?[\[(]dot[\])] ?)\S+)*")


class _Fold(dict):
    """Character by character: no case, no accents, digits as blanks; the length stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if "가" <= c <= "힣":  # a syllable is one letter
            self[code] = c
            return c
        base = [x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)]
        self[code] = out = " " if c.isdigit() or not base else base[0]
        return out


_FOLD = _Fold()

RESULT = "languages array<struct<lang:string,sentences:int,chars:int,confidence:double>>"
SEGMENTS = "segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def language_tag(label: Column) -> Column:
    """The ISO 639-1 code that a code, tag or name stands for; null if it names no known language."""
    t = F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return F.coalesce(names[t], names[F.element_at(F.split(t, "[-_]"), 1)])


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences: lines, and within them what ends in a full stop or stands between bars.

    A long line without an end that goes on in lower case is one sentence with the next.
    """
    out: list[tuple[int, int]] = []
    start = 0
    for m in _GAP.finditer(text):
        a, b = m.span()
        first = text[a]
        if first in _LINE_ENDS:
            if b < len(text) and text[b].islower() and a - start > WRAPPED and text[a - 1] not in ".!?…:;" and text.count("\n", a, b) < 2:
                continue
            end = a
        else:
            end = a + (first not in "|·")
        if end > start:
            out.append((start, end))
        start = b
    if start < len(text):
        out.append((start, len(text)))
    return out


def _has_contact(s: str) -> bool:
    return "@" in s or "at]" in s or "at)" in s or " dot " in s


def folded_sentences(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and folded text of the sentences with enough words to count.

    What tells the language whoever typed it remains: no case, accents, digits, bullets or mail addresses.
    """
    if not text:
        return []
    f = text.translate(_FOLD)
    contact = _has_contact(f)
    dense = not f.isascii() and _DENSE.search(f) is not None
    out = []
    for a, b in sentences(text):
        if b - a > 2 * MIN_WORDS or dense and b - a >= _DENSE_WORD * MIN_WORDS:
            s = f[a:b]
            if contact and _has_contact(s):
                s = _CONTACT.sub(" ", s)
            words = s.lstrip(_BULLETS).split()
            n = len(words)
            if n >= 2 * MIN_WORDS or n >= MIN_WORDS and sum(1 for w in words if w.isalpha() or _LETTERS.search(w)) >= MIN_WORDS or dense and len(_DENSE.findall(s)) >= MIN_WORDS * _DENSE_WORD:
                out.append((a, b, " ".join(words)))
    return out


@dataclass(frozen=True)
class Model:
    """A dictionary per language."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def coders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(window_log=16, hash_log=13, chain_log=13, strategy=1, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))
        return out


class Classifier:
    """Classifies folded sentences; the results of repeated ones are kept."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.coders = model.coders()
        self.memo: dict[str, tuple[int, float]] = {}

    def learn(self, folded: Sequence[str]) -> None:
        """Put the results of ``folded`` into the memo: language (-1: rejected) and confidence."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [s for s in dict.fromkeys(folded) if s not in self.memo]
        if not new:
            return
        raw = [s.encode("utf-8", "replace") or b" " for s in new]
        sizes = np.array([[len(x) for x in c.multi_compress_to_buffer(raw, threads=1)] for c in self.coders])
        best = sizes.min(0)
        gaps = sizes - best
        gap = np.partition(gaps, 1, axis=0)[1] if len(sizes) > 1 else np.full(len(new), 99)
        k = np.where(gap < np.maximum(MARGIN, MARGIN_SHARE * best), -1, sizes.argmin(0))
        sure = 1.0 / np.power(2.0, -np.minimum(gaps, 60)).sum(0)  # a byte of margin halves the chance of the other language
        self.memo.update(zip(new, zip(k.tolist(), np.where(k < 0, 0.0, sure).tolist(), strict=True), strict=True))


def _summary(found: list[tuple[int, int, int, float]], names: Sequence[str]) -> list[dict]:
    by: dict[int, list[float]] = {}
    for a, b, k, c in found:
        if k >= 0:
            x = by.setdefault(k, [0, 0, 0.0])
            x[0] += 1
            x[1] += b - a
            x[2] += (b - a) * c
    top = sorted(by.items(), key=lambda x: (-x[1][1], names[x[0]]))
    return [{"lang": names[k], "sentences": n, "chars": chars, "confidence": w / chars} for k, (n, chars, w) in top]


def _segments(found: list[tuple[int, int, int, float]], names: Sequence[str]) -> list[dict]:
    """Runs of sentences of one language; rejected ones join the run they stand in."""
    out: list[dict] = []
    for a, b, k, c in found:
        if k < 0:
            continue
        if out and out[-1]["lang"] == names[k]:
            x = out[-1]
            x["confidence"] = (x["confidence"] * (x["end"] - x["start"]) + c * (b - a)) / (x["end"] - x["start"] + b - a)
            x["end"] = b
        else:
            out.append({"start": a, "end": b, "lang": names[k], "confidence": c})
    return out


def identify(df: DataFrame, model: Model, text: str, keep: Sequence[str], segments: bool = False) -> DataFrame:
    """The columns ``keep`` and ``languages`` (most text first) of each row, with ``segments`` if asked for.

    A language is held by a text if a sentence of six or more words is in it. A null, empty or blank text,
    and one without such a sentence, holds none: its arrays are empty. Whole texts are read, and every row
    comes out; columns not in ``keep`` are not read.
    """
    kept = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", " + RESULT + (", " + SEGMENTS if segments else "")
    result = pa.list_(pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("chars", pa.int32()), ("confidence", pa.float64())]))
    parts = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        memo, names = c.memo, c.languages
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                texts = [folded_sentences(t) for t in part.column(part.num_columns - 1).to_pylist()]
                c.learn([s[2] for t in texts for s in t])
                found = [[(x, y, *memo[s]) for x, y, s in t] for t in texts]
                cols = [pa.array([_summary(f, names) for f in found], result)]
                if segments:
                    cols.append(pa.array([_segments(f, names) for f in found], parts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*keep, "languages", *["segments"] * segments])

    return kept.mapInArrow(run, schema)


def train(docs: DataFrame, text: str, label: str, ident: str, per_language: int = 300, per_document: int = 200, least: int = 3, rounds: int = 3) -> Model:
    """Dictionaries from about ``per_language`` (at most twice that) labelled documents a language, chosen by hash of the id.

    Of each at most ``per_document`` different sentences, also chosen by hash, are sent to the driver. Languages with fewer than
    ``least`` labelled documents are left out. The bounds hold for the sample that is learnt from; all that is classified
    with the model is read in full.
    """
    tagged = docs.select(F.xxhash64(F.col(ident)).alias("h"), language_tag(F.col(label)).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    sizes = {r.l: r.n for r in docs.select(language_tag(F.col(label)).alias("l")).where("l is not null").groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect() if r.n >= least}
    if not sizes:
        raise ValueError("no labelled documents to learn from")
    # about per_language rows of each language pass this filter, so that only they are read further
    pick = F.lit(False)
    for lang, n in sorted(sizes.items()):
        share = min(1.0, per_language / n)
        pick = pick | ((F.col("l") == lang) & (F.pmod(F.col("h"), F.lit(1_000_003)) < int(share * 1_000_003) + 1))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    sample = tagged.where(pick).withColumn("k", place).where(F.col("k") <= 2 * per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, found = b.column(0), [Counter(s for _, _, s in folded_sentences(t)) for t in b.column(1).to_pylist()]
            some = [sorted(c, key=hash_text)[:per_document] for c in found]
            row = pa.array([k for k, own in enumerate(some) for _ in own], pa.int64())
            kept = pa.array([s.encode("utf-8", "replace").decode() for own in some for s in own], pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(row), kept, pa.array([c[s] for c, own in zip(found, some, strict=True) for s in own], pa.int64())], ["l", "s", "n"])

    pool: dict[str, Counter[str]] = {}
    for r in sample.select("l", "t").mapInArrow(run, "l string, s string, n bigint").groupBy("l", "s").agg(F.sum("n").alias("n")).collect():
        pool.setdefault(r.l, Counter())[r.s] = r.n
    return fit(pool, rounds)


def _units(s: str) -> set[str]:
    """The words of a folded sentence; of scripts without blanks the pairs of characters."""
    words = set(_LETTERS.findall(s))
    if s.isascii() or not _DENSE.search(s):
        return words
    return {w for w in words if not _DENSE.search(w)} | {w[i : i + 2] for w in words if _DENSE.search(w) for i in range(max(1, len(w) - 1))}


def _relabel(pool: dict[str, Counter[str]], rounds: int) -> dict[str, list[str]]:
    """The sentences by the language whose labelled sentences use their words most.

    Wrong labels and mixed-in sentences are a minority of each language's sample, so their words are
    relatively rarer there than where they belong. Sentences near a tie are left out.
    """
    languages = sorted(pool)
    words = {s: _units(s) for own in pool.values() for s in own}
    now: dict[str, Counter[str]] = pool
    every: Counter[str] = Counter()
    for lang in languages:
        every.update(dict(sorted(pool[lang].items())))
    for _ in range(rounds):
        log: dict[str, dict[str, float]] = {}
        floor: dict[str, float] = {}
        for lang in languages:
            n: dict[str, int] = {}
            for s, times in now[lang].items():
                for w in words[s]:
                    n[w] = n.get(w, 0) + times
            total = sum(n.values()) + 1.0
            log[lang] = {w: math.log((c + 0.1) / total) for w, c in n.items()}
            floor[lang] = math.log(0.1 / total)
        now = {lang: Counter() for lang in languages}
        for s, times in every.items():
            score = sorted(((sum(log[lang].get(w, floor[lang]) for w in words[s]), lang) for lang in languages), reverse=True)
            if len(score) == 1 or score[0][0] - score[1][0] > 1.0 + 0.2 * len(words[s]):
                now[score[0][1]][s] = times
    return {lang: sorted(own) for lang, own in now.items()}


def fit(pool: dict[str, Counter[str]], rounds: int = 3) -> Model:
    """Dictionaries from folded sentences (with their number) by label, relabelled ``rounds`` times."""
    good = _relabel(pool, rounds)
    raw = []
    for lang in sorted(pool):
        out, size = [], 0
        seen: set[tuple[str, str]] = set()
        later = []
        own = sorted(good[lang] or pool[lang], key=hash_text)
        for take_all in (False, True):  # what is new first, the rest as far as there is room
            for s in later if take_all else own:
                words = s.split(" ")
                pairs = set(zip(words, words[1:], strict=False))
                b = s.encode("utf-8", "replace")
                if not take_all and 3 * len(pairs - seen) < len(pairs):
                    later.append(s)
                elif size + len(b) + 1 <= DICTIONARY_BYTES:
                    seen |= pairs
                    out.append(b)
                    size += len(b) + 1
        raw.append(b"\n".join(reversed(out)) or b" ")
    return Model(tuple(sorted(pool)), tuple(raw))


def hash_text(s: str) -> bytes:
    """A fixed shuffle of sentences."""
    return hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest()
