"""Personal information in free text, found by bootstrapped contextual extraction.

Every text yields mentions: mail addresses, long numbers, capitalised runs and street-like spans, each
with the words around it. Mentions and contexts form a graph that Spark scores in rounds. Seeds are
instances whose kind is certain by shape (an international number, a mail address with its sign, a street with house number and
postcode) or by source (known people, the local parts of mail addresses). A context is as good as the instances it holds,
an instance as the contexts it stands in; so labels of any language become patterns, and these find identifiers
of unseen shape and names nobody has listed, and refuse what only looks like an address. Numbers meet by their shape,
names by their words, mail by its form and domain, streets by their form and name.

Each different text is read once (``extract``). Its mentions become rows of hashes in a table, from which both the graph
and the final scores are joins and group-bys of the engine, for a lexicon of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import store

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

_UP = "A-ZÀ-ÖØ-Þ"
_DASH = "\\-\u2010\u2011\u2012\u2013\u2014"
_BLANK = " \xa0\u2007\u2009\u202f"
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\xad"  # characters without width
_NAME_CHARS = rf"[\w.+%'{_HIDDEN}-]"
_SIGN = rf"[{_HIDDEN}]*(?:[@＠﹫]|&#64;|&#x40;|&commat;)[{_HIDDEN}]*"
_AT = re.compile(
    rf"<?(?:mailto:)?{_NAME_CHARS}+ ?(?:{_SIGN}|[\[(]at[\])]|\(@\)) ?[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?)[\w-]+)+>?|{_NAME_CHARS}+(?: \. {_NAME_CHARS}+)* {_SIGN} [\w-]+(?: ?\. ?[\w-]+)+", re.I
)
_SPELLED = re.compile(rf"{_NAME_CHARS}+(?: ?(?:[\[(]dot[\])]|\bdot\b) ?{_NAME_CHARS}+)* ?(?:[\[(]at[\])]|\bat\b) ?[\w-]+(?: ?(?:[\[(]dot[\])]|\bdot\b) ?[\w-]+)+", re.I)
# The digits from 0 to 9 as words (English, Indonesian, German, French, Spanish, Dutch).
_DIGIT_WORDS = """
zero one two three four five six seven eight nine
nol satu dua tiga empat lima enam tujuh delapan sembilan
null eins zwei drei vier fünf sechs sieben acht neun
zéro un deux trois quatre cinq six sept huit neuf
cero uno dos tres cuatro cinco seis siete ocho nueve
nul een twee drie vier vijf zes zeven acht negen
"""
_DIGIT_OF = {w: str(i) for line in _DIGIT_WORDS.split("\n") for i, w in enumerate(line.split())}
_SAID = re.compile(rf"\b(?:{'|'.join(sorted(_DIGIT_OF))})(?:[ ,-]{{1,2}}(?:{'|'.join(sorted(_DIGIT_OF))})\b){{6,}}", re.I)
_DIGITS = tuple(line.split()[0] for line in _DIGIT_WORDS.split("\n") if line)  # a number said digit by digit begins with a zero or a plus, or holds one
_DIGITS = re.compile(rf"\d(?:(?:[{_BLANK}.()/{_DASH}]{{0,3}}|-\r?\n)\d){{6,}}(?:[{_BLANK}]?(?:ext|EXT|x)\.?[{_BLANK}]?\d+)?(?!\w)")
_BEFORE = re.compile(rf"(?:(?:^|(?<=[^A-Za-z]))(?:[{_UP}]{{2}}[{_BLANK}{_DASH}]?|[{_UP}]))?[+(]*$")
# Words and word parts that name streets and post boxes.
_STREET_FIRST = "jl jln jalan calle avenida avda paseo plaza rue avenue boulevard chemin quai impasse allée allee am im zum zur"
_STREET_LAST = "street road lane avenue drive way court close terrace place square row hill crescent boulevard gardens walk mews quay"
_STREET_END = "straße strasse str weg gasse platz allee ufer ring damm straat laan plein kade gracht dijk steeg singel hof pad"
_BOX = r"p\.? ?o\.? ?box|post ?box|postfach|postbus|apartado(?: de correos)?|kotak pos|bo[iî]te postale|b\.p\.|bp"
_STREET_TUPLE = tuple(_STREET_END.split())
_STREET_SET = frozenset(f"{_STREET_FIRST} box pobox postbox postfach postbus apartado pos postale bp".split())
_NUMBERED_SET = frozenset(f"{_STREET_LAST} calle avenida avda paseo plaza rue avenue boulevard chemin quai impasse allée allee jalan jl jln".split())
_BOX_PARTS = ("box", "postfach", "postbus", "apartado", "kotak pos", "postale", "b.p.", "bp")
_JOINED = re.compile(rf"[-'’](?:{_STREET_FIRST.replace(' ', '|')})\b")
_HOUSE_FIRST = frozenset("n#" + "".join(c for c in map(chr, range(0x110000)) if c.isdecimal()))  # what a house number or the word before it begins with
_PASSED = frozenset(".\n\r")  # tokens that may stand between a street and its number
_W = r"[^\W\d_][\w'’-]*"
_HOUSE = r"(?:no\.?|nr\.?|n°|nomor|number|nummer|núm\.?|#)?\s?\d{1,4}\s?(?:[a-z]\b|bis\b|ter\b)?"
_ADDRESS_WORD = re.compile(
    rf"\b(?P<street>{_STREET_FIRST.replace(' ', '|')})\b\.? (?:{_W} ){{0,4}}?{_W},? {_HOUSE}"
    rf"|\b(?P<box>{_BOX})(?: (?:no\.?|nr\.?|nomor))? ?\d+",
    re.I,
)
_ADDRESS_END = re.compile(rf"\b[\w'’-]+(?P<street>{_STREET_END.replace(' ', '|')})\b\.? {_HOUSE}", re.I)
_ADDRESS_NUMBER = re.compile(
    rf"\d{{1,4}}\s?(?:[a-z]|bis|ter)?,? (?P<street>calle|avenida|avda|paseo|plaza|rue|avenue|boulevard|chemin|quai|impasse|all[ée]e|jalan|jl|jln)\.? {_W}(?: (?-i:(?:d[aeu]l?|des|la|las|los|[{_UP}])[\w'’-]*)){{0,2}}"
    rf"|\d{{1,4}}\s?[a-z]? (?:{_W} ){{1,3}}(?P<last>{_STREET_LAST.replace(' ', '|')})\b(?=\s*(?:[,.;|\n]|$))",
    re.I,
)
# What follows a certain address: postcode and place, place and postcode, or a neighbourhood number.
_TAIL = re.compile(rf"[a-z]?,?\s(?:\d{{4,5}}(?: [{_UP}]{{2}})? [^\W\d_]|(?:[^\W\d_][\w'’-]* ){{1,3}}\d{{4,5}}\b|RT ?\d+/RW ?\d+)")
_NUMBERED = re.compile(r"(?:\bno\.?|\bnr\.?|n°|\bnomor|\bnumber|\bnummer|\bnúm\.?|#)\s?\d+\s?[a-z]?$", re.I)
_COMMON = frozenset("am im zum zur ring hof pad".split())  # street words that are ordinary words or word ends
_HOUSE_WORDS = frozenset("no nr nomor number nummer núm bis ter".split())
_TOKEN = re.compile(r"[^\W_][\w'’-]*|[.:,;|·!?…\n\r#№]")
_PUNCTUATION = frozenset(".,")
_ENDS = frozenset(".;|·!?…\n\r")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_LOCAL = re.compile(r"[@＠﹫]|&#64;|&#x40;|&commat;|[\[(]at[\])]|\bat\b", re.I)
_WIDTHLESS = re.compile(f"[{_HIDDEN}]")
_DOT = re.compile(r"\s*[\[(]dot[\])]\s*|\s+dot\s+")
_NOT_NAMES = frozenset("dot mailto job mail info post the".split())
_SURE_PHONE = re.compile(r"\+|08x|08 x|\(xxx\) ?xxx-xxxx")
_SURE_ID = re.compile(r"(?:xxx-xx-xxxx|x{4} x{4} x{4} x{4}|x{16})$")
CERTAIN = {"phone": 1, "id_number": 2, "address": 3, "email": 4}  # the kind that an instance is certain of

Special = tuple[int, int, str, str]  # start, end, type, key
Context = tuple[str, str, str, str]


class Mention(NamedTuple):
    """``family`` (E mail, A street-like or capitalised run with a number, D long number, N capitalised run, S words of a mail
    address), instances, the kind they are certain of (0: none), context, first and last token."""

    family: str
    instances: tuple[str, ...]
    certain: int
    context: Context
    first: int
    last: int


def shape(number: str) -> str:
    """A number with its digits as x; a leading 0 keeps its next digit, separators are plain ones."""
    s = re.sub(rf"[{_DASH}]", "-", re.sub(rf"[{_BLANK}]", " ", number.replace("\r", "").replace("\n", "")))
    lead = re.match(r"\(?0 ?[08]", s)
    head = lead.group() if lead else ""
    body = re.sub(r"\d", "x", re.sub(r"[A-Z](?=[A-Z]?[ -]?\d)|(?<=[A-Z])[A-Z]", "A", s[len(head) :]))
    return (head.replace("0 8", "08") + body).strip()


def _before(words: Sequence[str], i: int) -> str:
    """The token before the i-th, without those that may stand between a street and its number."""
    i -= 1
    while i > 0 and words[i] in _PASSED:
        i -= 1
    return words[i] if i >= 0 else ""


def specials(text: str, words: Sequence[str] | None = None) -> list[Special]:
    """Mail addresses, street-like spans and long numbers, in this order of right; ``words`` are the lower-case tokens."""
    out: list[Special] = []
    free = lambda a, b: all(b <= x or y <= a for x, y, *_ in out)
    low = text.lower()
    if words is None:
        words = _TOKEN.findall(low)
    if "@" in low or "＠" in low or "﹫" in low or "at]" in low or "at)" in low or "&#" in low or "&commat" in low:
        out += [(*m.span(), "E", m.group()) for m in _AT.finditer(text)]
    if "dot" in low and ("at]" in low or "at)" in low or " at " in low):
        out += [(*m.span(), "E", m.group()) for m in _SPELLED.finditer(text) if free(*m.span())]
    if len([1 for w in words for x in (w.split("-") if "-" in w else (w,)) if x in _DIGIT_OF]) > 6:
        for m in _SAID.finditer(text):
            if free(*m.span()):
                out.append((*m.span(), "D", shape("".join(_DIGIT_OF[w] for w in _LETTERS.findall(m.group().lower())))))
    digits = None
    if _DIGIT.search(text):
        digits = _DIGITS.search(text)
        rules = []
        if not _NUMBERED_SET.isdisjoint(words):
            rules.append(_ADDRESS_NUMBER)
        # these tests let through all that the patterns can match; a token may end in a street word ("l'avenue") or be followed by others (". 12", "n° 12")
        if not _STREET_SET.isdisjoint(words) or [1 for x in _BOX_PARTS if x in low] or _JOINED.search(low):
            rules.append(_ADDRESS_WORD)
        if [1 for i, x in enumerate(words) if x[0] in _HOUSE_FIRST and _before(words, i).endswith(_STREET_TUPLE)]:
            rules.append(_ADDRESS_END)
        for rule in rules:
            out += [(*m.span(), "A", _street(text, m)) for m in rule.finditer(text) if free(*m.span()) and not text[m.start() - 1 : m.start()].isalnum()]
    if digits:
        for m in _DIGITS.finditer(text):
            head = _BEFORE.search(text[max(0, m.start() - 4) : m.start()])
            lead = head.group()
            phone = m.group().startswith(("08", "00")) and not lead[-1:].isalpha() and sum(map(str.isdigit, m.group())) > 8
            if lead and lead[0].isalpha() and (lead[-1] in "+(" or phone):
                lead = lead.lstrip("".join(c for c in lead if c not in "+("))  # a word before a phone number, not part of it
            a = m.start() - len(lead)
            before = text[a - 1 : a]
            if free(a, m.end()) and not (before.isalnum() or before in ("/", "_")):
                out.append((a, m.end(), "D", shape(text[a : m.end()])))
    return sorted(out)


def _street(text: str, m: re.Match[str]) -> str:
    """The form of a street-like span (its street word, and + if it is certain by shape), a bar and the words of its name.

    Certain are post boxes, a number word, what ``_TAIL`` follows, and (in text with case) a street in proper-noun form, unless
    its street word is common elsewhere. The rest is for the contexts to decide.
    """
    g = m.groupdict()
    if g.get("box"):
        return "box+|"
    where = "street" if g.get("street") else "last"
    word = g[where].lower()
    sure = bool(_TAIL.match(text, m.end()) or where == "street" and _NUMBERED.search(m.group()))
    if not sure and word not in _COMMON and not _no_case(text):
        a, b = m.span(where)
        rest = [w for w in _LETTERS.findall(f"{text[m.start() : a]} {text[b : m.end()]}") if len(w) > 3 and w.lower() not in _HOUSE_WORDS]
        joined = a > m.start() and text[a - 1].isalpha()  # the street word ends a longer word
        if joined:
            sure = text[m.start()].isupper()
        else:
            sure = bool(rest) and all(w[0].isupper() for w in rest) and (where == "street" or text[a].isupper())
    name = " ".join(w for w in _LETTERS.findall(m.group().lower()) if len(w) > 1 and w not in _HOUSE_WORDS)
    return f"{word}{'+' * sure}|{name}"


def _context(low: Sequence[str], i: int, j: int) -> Context:
    """The words around the tokens i..j-1, two on either side; ^ and $ are sentence ends."""
    l1 = low[i - 1] if i else "^"
    if l1 in _ENDS:
        l1 = "^"
    l2 = "" if l1 == "^" else low[i - 2] if i > 1 else "^"
    if l2 in _ENDS:
        l2 = "^"
    n = len(low)
    r1 = low[j] if j < n else "$"
    if r1 in _ENDS:
        r1 = "$"
    r2 = "" if r1 == "$" or j + 1 >= n else low[j + 1]
    if r2 in _ENDS:
        r2 = "$"
    return l2, l1, r1, r2


def patterns(c: Context) -> tuple[str, str, str]:
    """The lexical patterns of a context: two before, two after, one on either side."""
    l2, l1, r1, r2 = c
    return f"{l2} {l1} _", f"_ {r1} {r2}", f"{l1} _ {r1}"


def _tokens(text: str) -> tuple[list[str], list[str]]:
    """The tokens, and the same in lower case."""
    toks, lowered = _TOKEN.findall(text), text.lower()
    low = _TOKEN.findall(lowered)
    return toks, low if len(low) == len(toks) and len(lowered) == len(text) else [t.lower() for t in toks]


def _masked(text: str, found: Sequence[Special]) -> tuple[list[str], list[str], list[int]]:
    """Tokens and lower-case tokens with each special span as one token (its type), and the places of these."""
    toks, low, at, pos = [], [], [], 0
    for a, b, kind, _ in found:
        t, w = _tokens(text[pos:a])
        toks += t
        low += w
        at.append(len(toks))
        toks.append(kind)
        low.append(f"<{kind}>")
        pos = b
    t, w = _tokens(text[pos:])
    return toks + t, low + w, at


def _special(kind: str, key: str, around: Context, i: int) -> list[Mention]:
    if kind == "D":
        certain = CERTAIN["phone"] if _SURE_PHONE.match(key) else CERTAIN["id_number"] if _SURE_ID.match(key) else 0
        return [Mention("D", (key,), certain, around, i, i + 1)]
    if kind == "A":
        form, name = key.split("|")
        return [Mention("A", (form, name) if name else (form,), CERTAIN["address"] * form.endswith("+"), around, i, i + 1)]
    low = _WIDTHLESS.sub("", key.lower().replace("mailto:", ""))
    own = _LETTERS.findall(_LOCAL.split(low)[0].split("+")[0])
    words = tuple(w for w in own if len(w) > 2 and w not in _NOT_NAMES)
    form = "@" if "@" in key and " " not in key else "split" if "@" in key else "bracket" if "[" in key or "(" in key else "spelled"
    domain = _DOT.sub(".", _LOCAL.split(low)[-1]).replace(" ", "").rstrip(">")
    out = [Mention("E", (form, f"@{domain}"), CERTAIN["email"] * (form == "@"), around, i, i + 1)]
    return [*out, Mention("S", words, 0, around, i, i + 1)] if words else out


def mentions(text: str, known: frozenset[str] | None = None) -> list[Mention]:
    """All mentions among the tokens of the text.

    Names are capitalised runs. In text without case they are runs of ``known`` words; with ``known`` given, only these come out.
    """
    toks, low = _tokens(text)
    found = specials(text, low)
    special: dict[int, Special] = {}
    if found:
        toks, low, at = _masked(text, found)
        special = dict(zip(at, found, strict=True))
    out: list[Mention] = []
    n = len(toks)
    if known is None:
        for i, (_, _, kind, key) in special.items():
            out += _special(kind, key, _context(low, i, i + 1), i)
        if _no_case(text):
            return out
        caps = [i for i, t in enumerate(toks) if t[0].isupper() and i not in special]
    else:
        caps = [i for i, w in enumerate(low) if w in known]
    k = 0
    while k < len(caps):
        i = caps[k]
        j = i + 1
        k += 1
        while k < len(caps):
            gap = caps[k] - j
            if gap == 0 or gap == 1 and (toks[j] == "," and j - i <= 2 or toks[j] == "." and len(toks[j - 1]) < 4):
                j = caps[k] + 1
                k += 1
            else:
                break
        if j < n and j not in special and toks[j][0].isdigit() and len(toks[j]) < 6 and len(_LETTERS.findall(toks[j])) < 2:
            out.append(Mention("A", ("H", " ".join(low[i:j])), 0, _context(low, i, j + 1), i, j + 1))
        out.append(Mention("N", _words(toks, low, i, j), 0, _context(low, i, j), i, j))
        # a sentence's first word, or the first two words of a longer run, may be none of the name
        starts = [1] if j - i > 1 and (i == 0 or low[i - 1] in _ENDS) else []
        if j - i > 2:
            starts = [1, 2]
        for x in starts if known is None else ():
            x += i + (toks[i + x] in _PUNCTUATION)
            if x < j:
                out.append(Mention("N", _words(toks, low, x, j), 0, _context(low, x, j), x, j))
    return out


def _words(toks: Sequence[str], low: Sequence[str], i: int, j: int) -> tuple[str, ...]:
    """The words of a run that can be names: three letters and more, or two if only the first is a capital."""
    return tuple(w for t, w in zip(toks[i:j], low[i:j], strict=True) if w[0].isalpha() and (len(w) > 2 or len(w) == 2 and t[1].islower()))


def _no_case(text: str) -> bool:
    return text.isupper() or text.islower()


def redact(text: str, hits: Sequence[tuple[int, int, str]]) -> str:
    """``text`` with a typed placeholder for each (first, last token, kind) of ``hits``, all else kept."""
    places: list[tuple[int, int]] = []
    at = 0
    for a, b, *_ in [*specials(text), (len(text), len(text))]:
        places += [(at + m.start(), at + m.end()) for m in _TOKEN.finditer(text[at:a])]
        if b > a:
            places.append((a, b))
        at = b
    out, at = [], 0
    for a, b, kind in sorted((places[i][0], places[j - 1][1], kind) for i, j, kind in hits):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "h1 bigint, h2 bigint, n bigint, no int, family string, p0 bigint, p1 bigint, p2 bigint, instances array<bigint>, certain int, first int, last int, text string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.string()]
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
MEMO = 300_000  # hashes of contexts and words kept per worker


def _hash(word: str) -> int:
    """The engine's own ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


class _Rows:
    """Mentions as columns of ``SCHEMA``."""

    def __init__(self) -> None:
        self.contexts: dict[Context, tuple[int, int, int]] = {}
        self.words: dict[tuple[str, ...], list[int]] = {}

    def batch(self, b: pa.RecordBatch, found: Sequence[Sequence[Mention]], texts: Sequence[str | None]) -> pa.RecordBatch:
        """The mentions of each row of ``b`` (h1, h2, n first); a text in ``texts`` comes out as a row of its own."""
        if len(self.contexts) + len(self.words) > MEMO:
            self.contexts.clear()
            self.words.clear()
        row: list[int] = []
        cols: list[list] = [[] for _ in _FIELDS[3:]]
        no, family, p0, p1, p2, instances, certain, first, last, text = cols
        for k, own in enumerate(found):
            for q, m in enumerate(own):
                c = self.contexts.get(m.context)
                if c is None:
                    c = self.contexts[m.context] = tuple(map(_hash, patterns(m.context)))
                w = self.words.get(m.instances)
                if w is None:
                    w = self.words[m.instances] = [_hash(x) for x in m.instances]
                row.append(k)
                no.append(q)
                family.append(m.family)
                p0.append(c[0])
                p1.append(c[1])
                p2.append(c[2])
                instances.append(w)
                certain.append(m.certain)
                first.append(m.first)
                last.append(m.last)
        text += [None] * len(row)
        for k, t in enumerate(texts):
            if t is not None:
                row.append(k)
                for c, v in zip(cols, (-1, "L", 0, 0, 0, [], 0, 0, 0, t), strict=True):
                    c.append(v)
        at = pa.array(row, pa.int64())
        arrays = [b.column(x).take(at) for x in range(3)]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(cols, _TYPES[3:], strict=True)], _FIELDS)


def extract(df: DataFrame, column: str) -> DataFrame:
    """The mentions of the different texts in ``column``: a stored table of ``SCHEMA``.

    ``h1`` and ``h2`` stand for the text, ``n`` is how many rows have it. Patterns and instances are hashes. A text without case is kept
    as a row of family L, as its names are found by what the others taught. Null and empty texts have no rows.
    """
    text = F.col(column).cast("string").alias("text")
    different = df.select(text).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for b in batches:
            texts = b.column(3).to_pylist()
            yield rows.batch(b, [mentions(t) for t in texts], [t if _no_case(t) else None for t in texts])

    return store(different.select(*_text_key(F.col("text")), "n", "text").mapInArrow(run, SCHEMA), "mentions")


FLOOR = -3.0  # log odds of what the lexicon lacks, and the least that it holds
LEARNT_LIMIT = 2.0  # log odds that a form or name of street or mail can reach without being certain anywhere


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    return F.ln(q / (F.lit(1.0) - q))


def _kinds() -> Column:
    """The kinds that a mention's family may be."""
    return (
        F.when(F.col("family") == "N", F.array(F.lit("name")))
        .when(F.col("family") == "D", F.array(F.lit("phone"), F.lit("id_number")))
        .when(F.col("family") == "E", F.array(F.lit("email")))
        .otherwise(F.array(F.lit("address")))
    )


def learn(corpus: DataFrame, people: DataFrame, rounds: int = 3, support: int = 3) -> DataFrame:
    """Score the graph of the mentions of ``extract``: instance (or pattern), kind, value (its hash), odds; a stored table.

    ``people`` has one text column with names of known people. Each round scores every context by the share
    of its mentions that are certain or believed to be of the kind, then every uncertain instance by the mean log odds of
    its contexts with at least ``support`` mentions. All texts take part; counts are summed before each shuffle.
    Odds are kept above ``FLOOR`` only, which is what all else counts for.
    """
    words = people.select(F.explode(F.regexp_extract_all(F.lower(people.columns[0]), F.lit(r"([\\p{L}]{3,})"), 1)).alias("w")).select(F.xxhash64("w").alias("instance"))
    locals_ = corpus.where("family = 'S'").select(F.explode("instances").alias("instance"))
    seeds = store(words.unionByName(locals_).distinct().withColumn("seed", F.lit(True)), "seeds")
    spread = corpus.where("family not in ('S', 'L')").select("family", "n", "certain", "instances", F.explode(F.array("p0", "p1", "p2")).alias("pattern"))
    graph = spread.select("family", "n", "certain", "pattern", F.explode("instances").alias("instance")).groupBy("family", "pattern", "instance", "certain").agg(F.sum("n").alias("n"))
    kind_code = F.create_map(*[F.lit(x) for pair in CERTAIN.items() for x in pair])
    sure = F.when(F.col("seed") & (F.col("kind") == "name"), 1.0).when(F.col("certain") > 0, F.when(F.col("certain") == kind_code[F.col("kind")], 1.0).otherwise(0.0))
    e = graph.select("*", F.explode(_kinds()).alias("kind"))
    e = store(e.join(seeds, "instance", "left").select("kind", "pattern", "instance", "n", sure.alias("sure")), "graph")
    score = e.groupBy("kind", "instance").agg(F.coalesce(F.max("sure"), F.lit(0.0)).alias("score"))
    patterns = None
    for _ in range(rounds):
        joined = e.join(score, ["kind", "instance"])
        patterns = joined.groupBy("kind", "pattern").agg(F.sum("n").alias("m"), (F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("p")).where(F.col("m") >= support)
        patterns = store(patterns.select("kind", "pattern", _logit(F.col("p")).alias("odds")), "patterns")
        believed = e.join(patterns, ["kind", "pattern"], "left").groupBy("kind", "instance").agg(
            F.max("sure").alias("sure"), F.sum(F.col("n") * F.col("odds")).alias("a"), F.sum(F.when(F.col("odds").isNotNull(), F.col("n"))).alias("b")
        )
        sigmoid = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("a") / F.col("b")))
        score = store(believed.select("kind", "instance", F.coalesce("sure", sigmoid, F.lit(0.0)).alias("score"), F.col("sure").isNotNull().alias("known")), "instances")
    learnt = F.col("kind").isin("address", "email") & ~F.col("known")
    odds = F.when(learnt, F.least(_logit(F.col("score")), F.lit(LEARNT_LIMIT))).otherwise(_logit(F.col("score")))
    good = patterns.select(F.lit(False).alias("instance"), "kind", F.col("pattern").alias("value"), "odds")
    inst = score.select(F.lit(True).alias("instance"), "kind", F.col("instance").alias("value"), odds.alias("odds"))
    names = seeds.select(F.lit(True).alias("instance"), F.lit("name").alias("kind"), F.col("instance").alias("value"), _logit(F.lit(1.0)).alias("odds"))
    every = good.unionByName(inst).unionByName(names).where(F.col("odds") > FLOOR)
    return store(every.groupBy("instance", "kind", "value").agg(F.max("odds").alias("odds")), "lexicon")


def _caseless(corpus: DataFrame, learned: DataFrame) -> DataFrame:
    """The name mentions of texts without case: runs of words that are known as names."""
    texts = corpus.where("family = 'L'").select("h1", "h2", "n", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value = [], []
            for k, t in enumerate(b.column(3).to_pylist()):
                own = {_hash(w) for w in _masked(t, specials(t))[1]}
                at += [k] * len(own)
                value += own
            row = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(value, pa.int64())], ["h1", "h2", "value"])

    names = learned.where("instance and kind = 'name' and odds > 0").select("value")
    known = texts.mapInArrow(words, "h1 bigint, h2 bigint, value bigint").join(names, "value").groupBy("h1", "h2").agg(F.collect_set("value").alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for b in batches:
            found = []
            for t, k in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                ours = set(k)
                found.append(mentions(t, frozenset(w for w in _masked(t, specials(t))[1] if _hash(w) in ours)))
            yield rows.batch(b, found, [None] * b.num_rows)

    return texts.join(known, ["h1", "h2"]).select("h1", "h2", "n", "text", "known").mapInArrow(run, SCHEMA).withColumn("no", F.col("no") + 1_000_000_000)


def accept(corpus: DataFrame, learned: DataFrame) -> DataFrame:
    """What the lexicon accepts of the mentions of ``extract``: h1, h2 and hits (kind, first, last token), one row per text with any; a stored table.

    The log odds of a mention are the mean of its two best contexts and of its instances, in equal parts; they must be
    above 0. Most mentions share nothing with the lexicon and end in the first join. Names within an address are part of it.
    """
    every = corpus.where("family not in ('S', 'L')").unionByName(_caseless(corpus, learned))
    key = lambda slot, value: F.named_struct(F.lit("slot"), F.lit(slot), F.lit("value"), value)
    keys = F.concat(F.array(*[key(i, F.col(f"p{i}")) for i in range(3)]), F.transform("instances", lambda x: key(3, x)))
    asked = every.select("h1", "h2", "no", "first", "last", F.size("instances").alias("size"), F.explode(_kinds()).alias("kind"), keys.alias("keys")).where("size > 0")
    asked = asked.select("*", F.explode("keys").alias("k")).select("h1", "h2", "no", "first", "last", "size", "kind", "k.slot", "k.value", (F.col("k.slot") == 3).alias("instance"))
    met = asked.join(learned, ["instance", "kind", "value"]).repartition("h1", "h2")
    slot = [F.coalesce(F.max(F.when(F.col("slot") == i, F.col("odds"))), F.lit(FLOOR)) for i in range(3)]
    own = (F.coalesce(F.sum(F.when(F.col("slot") == 3, F.col("odds"))), F.lit(0.0)) + (F.max("size") - F.count_if(F.col("slot") == 3)) * FLOOR) / F.max("size")
    best = (slot[0] + slot[1] + slot[2] - F.least(*slot)) / 2
    scored = met.groupBy("h1", "h2", "no", "kind").agg(F.max("first").alias("first"), F.max("last").alias("last"), ((best + own) / 2).alias("score")).where("score > 0")
    one = scored.groupBy("h1", "h2", "no").agg(F.max_by(F.struct("kind", "first", "last"), F.struct("score", "kind")).alias("x"))
    hits = one.groupBy("h1", "h2").agg(F.collect_list("x").alias("hits"))  # the mentions of a single text
    homes = F.filter("hits", lambda x: x["kind"] == "address")
    outside = F.filter("hits", lambda x: (x["kind"] != "name") | ~F.exists("homes", lambda y: (y["first"] < x["last"]) & (x["first"] < y["last"])))
    return store(hits.withColumn("homes", homes).select("h1", "h2", outside.alias("hits")).where(F.size("hits") > 0), "hits")


def find(df: DataFrame, column: str, keep: Sequence[str], hits: DataFrame) -> DataFrame:
    """The columns ``keep`` and ``kind``: one row per row of ``df`` and kind of personal information in ``column``.

    ``hits`` are those of ``accept`` for a corpus that holds the texts. A null or empty text has none.
    """
    kinds = hits.select("h1", "h2", F.explode(F.array_distinct(F.transform("hits", lambda x: x["kind"]))).alias("kind"))
    rows = df.where(F.col(column).cast("string") != "").select(*[F.col(c) for c in keep], *_text_key(F.col(column).cast("string")))
    return rows.join(kinds, ["h1", "h2"]).select(*keep, "kind")


def redacted(df: DataFrame, column: str, hits: DataFrame) -> DataFrame:
    """``df`` with ``column`` redacted by the ``hits`` of ``accept``. Null stays null, and a text without hits as it is."""
    columns, k = df.columns, df.columns.index(column)
    marks = hits.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("hits").alias("__hits"))
    h1, h2 = _text_key(F.col(column).cast("string"))
    rows = df.withColumn("__h1", h1).withColumn("__h2", h2).join(marks, ["__h1", "__h2"], "left").select(*[F.col(f"`{c}`") for c in columns], "__hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(b.num_columns - 1)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            text = b.column(k)
            if len(at):
                some = pa.array(at)
                new = [redact(t, [(h["first"], h["last"], h["kind"]) for h in x]) for t, x in zip(text.take(some).to_pylist(), found.take(some).to_pylist(), strict=True)]
                mask = np.zeros(b.num_rows, bool)
                mask[at] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], text, *b.columns[k + 1 : -1]], columns)

    return rows.mapInArrow(run, df.schema)
