"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import fixed as X

EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"  # fixed value
# Spans that may be phones: at least ten digits with the usual separators, told from date ranges by the digit count.
PHONE = r"(?<!\w)(?=\+?(?:[ ().-]*\d){10})\+?[\d(][\d ().-]{7,}\d(?!\w)"
LINE_END = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"
STOP_WORDS = tuple(sorted({*X.STOP_EN.split(), *X.STOP_ID.split()} - set(X.SIGNALS.split())))


def _phrases(text: str) -> str:
    """The alternatives of a list of phrases, longest first, with any white space for blanks."""
    every = [x for line in text.split("\n") for x in line.split("|") if x]
    return "|".join(x.replace(" ", r"\s+") for x in sorted(every, key=len, reverse=True))


_LABEL = {
    "taxonomy": rf"(?i)^\s*(?:{_phrases(X.TAXONOMY_LABELS)}|{X.TAXONOMY_NUMBERED})\s*[:|–-]",
    "live": rf"(?i)^\s*(?:{_phrases(X.LIVE_LABELS)}|{X.LIVE_NUMBERED})\s*[:|–-]",
}
_BIRTH = {"taxonomy": X.TAXONOMY_BIRTH, "live": X.LIVE_BIRTH}


def collapse_blanks(text: Column) -> Column:
    """White space as single blanks; text that has no other is not rewritten, as replacing costs far more than looking."""
    return F.when(text.rlike(r"(?U)[^\S ]|  "), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)


def normalize(text: Column) -> Column:
    """Lower case, plain dashes, single blanks, no outer blanks."""
    return F.trim(collapse_blanks(F.replace(F.translate(F.lower(text), "–—", "--"), F.lit("ß"), F.lit("ss"))))


def lines(text: Column) -> Column:
    """The lines of a text in order, blank ones left out, otherwise untrimmed; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.filter(parts, lambda x: x.rlike(r"(?U)\S"))


def redact_email(text: Column, token: str = "[email removed]") -> Column:
    return F.regexp_replace(text, EMAIL, token.replace("[", "\\[").replace("]", "\\]"))


def redact_phone(text: Column, token: str = "[phone removed]") -> Column:
    """Spans of ten or more digits go; date ranges stay."""
    return F.regexp_replace(text, PHONE, token.replace("[", "\\[").replace("]", "\\]"))


def redact_birth(text: Column, token: str = "[birth date removed]", profile: str = "taxonomy") -> Column:
    return F.regexp_replace(text, f"(?i){_BIRTH[profile]}", token.replace("[", "\\[").replace("]", "\\]"))


def redact_age(text: Column, token: str = "[age removed]") -> Column:
    return F.regexp_replace(text, f"(?i){X.AGE}", token.replace("[", "\\[").replace("]", "\\]"))


def is_sensitive_line(line: Column, profile: str = "taxonomy") -> Column:
    """Whether a line begins with a label of personal data."""
    return line.rlike(_LABEL[profile])


def collapse(text: Column) -> Column:
    """White space as single blanks, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def redact_for_evidence(text: Column, limit: int = 700, profile: str = "taxonomy", focus: Column | None = None) -> Column:
    """Lines of personal data dropped, addresses and phones (``live``: and ages) replaced, blanks collapsed.

    What is longer than ``limit`` is cut there, or (``live``) to excerpts around the ``focus`` terms, an array of text.
    """
    kept = F.filter(lines(text), lambda x: ~is_sensitive_line(x, profile))
    clean = F.transform(kept, lambda x: redact_phone(redact_email(x)))
    if profile == "live":
        clean = F.transform(clean, lambda x: redact_age(x))
    flat = collapse(F.array_join(F.transform(clean, lambda x: redact_birth(x, profile=profile)), " "))
    if focus is None:
        return F.substring(flat, 1, limit)
    return F.transform(F.array(flat), lambda x: F.when(F.length(x) <= limit, x).otherwise(_excerpt(x, focus, limit)))[0]


def focused_excerpt(text: Column, terms: Sequence[str], limit: int = 700) -> Column:
    """``text`` up to ``limit``; if longer, the windows around the first whole-word place of each term."""
    return F.when(F.length(text) <= limit, text).otherwise(_excerpt(text, F.array(*[F.lit(t) for t in terms]), limit))


def _excerpt(text: Column, terms: Column, limit: int) -> Column:
    """Windows of 160 characters on either side of each term's first place, less by 20 until they fit; overlapping ones as one."""
    low = normalize(text)
    quoted = lambda t: F.concat(F.lit(r"(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))
    at = lambda t: F.struct((F.regexp_instr(low, quoted(t)) - 1).alias("a"), F.length(t).alias("n"))
    spots = F.filter(F.transform(F.filter(F.transform(terms, normalize), lambda t: t != ""), at), lambda x: x.getField("a") >= 0)
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    size = F.length(text)

    def join(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.named_struct(F.lit("a"), last["a"], F.lit("b"), F.greatest(last["b"], x["b"]))))
        return F.when((F.size(done) > 0) & (x["a"] <= last["b"]), merged).otherwise(F.concat(done, F.array(x)))

    def window(spots: Column, width: Column) -> Column:
        edge = lambda x: F.named_struct(F.lit("a"), F.greatest(x.getField("a") - width, F.lit(0)), F.lit("b"), F.least(x.getField("a") + x.getField("n") + width, size))
        spans = F.aggregate(F.array_sort(F.transform(spots, edge)), empty, join)
        part = lambda s: F.concat(F.when(s["a"] > 0, "…").otherwise(""), F.substring(text, s["a"] + 1, s["b"] - s["a"]), F.when(s["b"] < size, "…").otherwise(""))
        return F.array_join(F.transform(spans, part), " … ")

    def choose(spots: Column) -> Column:
        tried = F.transform(F.sequence(F.lit(160), F.lit(0), F.lit(-20)), lambda w: window(spots, w))
        fitting = F.filter(tried, lambda x: F.length(x) <= limit)
        return F.when(F.size(spots) == 0, F.substring(text, 1, limit)).otherwise(F.substring(F.coalesce(F.try_element_at(fitting, F.lit(1)), F.element_at(tried, -1)), 1, limit))

    return F.transform(F.array(spots), choose)[0]


def without_sensitive_lines(text: Column) -> Column:
    """The text without labelled lines of personal data, but with what follows a sentence's end or a heading in them."""

    def tail(line: Column) -> Column:
        rest = F.regexp_replace(line, _LABEL["live"], "")
        heading = rf"(?is)^.*?(?=\b(?:{_phrases(X.HEADINGS)})\b)"
        ends = F.array_compact(F.array(
            F.when(rest.rlike(r"[.!?]\s+(?=[A-Z])"), F.length(F.regexp_extract(rest, r"(?s)^.*?[.!?]\s+(?=[A-Z])", 0))),
            F.when(rest.rlike(heading), F.length(F.regexp_extract(rest, heading, 0))),
        ))
        return F.when(F.size(ends) > 0, F.substring(rest, F.array_min(ends) + 1, F.length(rest)))

    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.array_join(F.array_compact(F.transform(parts, lambda x: F.when(is_sensitive_line(x, "live"), tail(x)).otherwise(x))), "\n")


def word_pattern(term: str) -> str:
    """A regular expression for ``term`` between non-word characters."""
    special = set("\\.^$|?*+()[]{}")
    quoted = "".join("\\" + c if c in special else c for c in term.lower().strip())
    return rf"(?<!\w){quoted}(?!\w)"


def any_pattern(terms: Sequence[str]) -> str:
    return "|".join(word_pattern(t) for t in terms)


def holds(text: Column, term: str) -> Column:
    """Whether ``term`` stands in normalised text as a whole word; its longest part is looked for first, which is cheap."""
    return F.contains(text, F.lit(max(term.lower().split(), key=len))) & text.rlike(word_pattern(term))


def _alternation(names: Sequence[str]) -> str:
    """A pattern without width whose group 1 is the longest of ``names`` that begins at a place, in lower text with any white space."""
    quoted = [word_pattern(n)[len(r"(?<!\w)") : -len(r"(?!\w)")].replace(" ", r"\s+").replace("-", "[-–—]") for n in sorted(names, key=len, reverse=True)]
    return rf"(?U)(?<!\w)(?=({'|'.join(quoted)})(?!\w))"


def _beginnings(names: Sequence[str]) -> dict[str, list[str]]:
    """Every name with those that are whole words at its beginning, itself included."""
    low = {n: n.lower().strip() for n in names}
    return {low[n]: [m for m in names if low[n].startswith(low[m]) and not (low[n][len(low[m]) :][:1].isalnum() or low[n][len(low[m]) :][:1] == "_")] for n in names}


def skills(text: Column, names: Sequence[str]) -> Column:
    """Which of ``names`` occur as whole words, in the order of ``names``; one scan for all of them."""
    found = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_alternation(names)), 1)), normalize))
    inner = _beginnings(names)
    table = F.create_map(*[x for n, own in inner.items() for x in (F.lit(n), F.array(*[F.lit(m) for m in own]))])
    every = F.transform(F.array(found), lambda f: F.flatten(F.transform(f, lambda s: table[s])))[0]
    return F.transform(F.array(every), lambda e: F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(e, n)))[0]


def occurrences(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` in order: array of (before, found, after), with the 120 characters before each."""
    parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0)

    def build(parts: Column, found: Column) -> Column:
        def one(f: Column, i: Column) -> Column:
            lo = F.greatest(i - 60, F.lit(0))  # a part and a match have two characters or more
            joined = F.zip_with(F.slice(parts, lo + 1, i - lo + 1), F.slice(found, lo + 1, i - lo), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
            after = F.coalesce(F.try_element_at(parts, i + 2), F.lit(""))
            return F.named_struct(F.lit("before"), F.right(F.array_join(joined, ""), F.lit(120)), F.lit("found"), f, F.lit("after"), after)

        return F.transform(found, one)

    return F.transform(F.array(F.struct(parts.alias("p"), found.alias("f"))), lambda x: build(x.getField("p"), x.getField("f")))[0]


def is_denied(before: Column) -> Column:
    """Whether the text before a mention denies it: a cue in the same clause, at most six words before."""

    def judge(clause: Column) -> Column:
        last = rf"(?s)^.*\b({X.CUES})\b(.*)$"
        cue, words = F.regexp_extract(clause, last, 1), F.regexp_extract_all(F.regexp_extract(clause, last, 2), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), 0)
        first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
        harmless = F.lit(False)
        for cues, after in X.NOT_DENIED.items():
            harmless = harmless | (cue.isin(*cues) & first.isin(*after))
        return (cue != "") & (F.size(words) <= 6) & ~harmless

    return F.transform(F.slice(F.split(before, r"[.!?;,]"), -1, 1), judge)[0]


def negated_mentions(line: Column, terms: Sequence[str]) -> Column:
    """For each occurrence of one of ``terms`` in order, whether it is denied."""
    return F.transform(occurrences(normalize(line), any_pattern(sorted(terms, key=len, reverse=True))), lambda x: is_denied(x["before"]))


def live_skills(text: Column, names: Sequence[str] = X.LIVE_SKILLS) -> Column:
    """Which of ``names`` occur as whole words at least once without being denied, in the order of ``names``."""
    hits = occurrences(normalize(text), any_pattern(sorted(names, key=len, reverse=True)))
    good = F.transform(F.filter(hits, lambda x: ~is_denied(x["before"])), lambda x: x["found"])
    table = F.create_map(*[x for n, own in _beginnings(names).items() for x in (F.lit(n), F.array(*[F.lit(m) for m in own]))])
    every = F.flatten(F.transform(F.array_distinct(good), lambda s: table[s]))
    return F.transform(F.array(every), lambda e: F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(e, n)))[0]


def experience_years(text: Column) -> Column:
    """The largest number of years from 1 to 50 that is named as experience; null if none."""
    low = F.lower(text)
    patterns = (
        r"(\d{1,2})\s*\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:\w+\s+){0,3}?experience",
        r"experience\s*(?:of|:)?\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)",
        r"(\d{1,2})\s*\+?\s*tahun\s+(?:\w+\s+){0,2}?pengalaman",
        r"pengalaman\s+(?:\w+\s+){0,2}?(\d{1,2})\s*\+?\s*tahun",
    )
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), 1) for p in patterns])
    return F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.between(1, 50)))


_NUMBER = {**{w: float(i) for i, w in enumerate(X.NUMBERS_EN.split(), 1)}, **{w: float(i) for i, w in enumerate(X.NUMBERS_ID.split("|"), 1)}, "a": 1.0, "an": 1.0, "couple of": 2.0, "a couple of": 2.0}
_AMOUNT = "|".join(sorted([*_NUMBER, *X.VAGUE.split("|")], key=len, reverse=True))
_DURATION = rf"\b(?:(?:{X.ABOUT})\s+)?({_AMOUNT}|\d{{1,2}}(?:[.,]\d{{1,2}})?\+?)\s+(years?|yrs?|decades?|tahun|thn)\b"


def experience_duration(text: Column) -> Column:
    """Years of the first duration that is not an age; null if there is none."""
    return duration_mention(text)["years"]


def duration_mention(text: Column) -> Column:
    """The first duration that is not an age, as a struct (years, text): decades count ten, a few or several have null years; null if there is none."""
    own = lambda x: ~x["before"].rlike(X.AGE_BEFORE) & ~x["after"].rlike(r"^\s*(?:old\b|of\s+age\b)")
    table = F.create_map(*[F.lit(x) for pair in _NUMBER.items() for x in pair])

    def value(found: Column) -> Column:
        amount = F.regexp_replace(F.regexp_extract(found, _DURATION, 1), r"\+$", "")
        number = F.coalesce(F.replace(amount, F.lit(","), F.lit(".")).try_cast("double"), table[amount])
        return F.named_struct(F.lit("years"), number * F.when(F.regexp_extract(found, _DURATION, 2).startswith("decade"), 10.0).otherwise(1.0), F.lit("text"), found)

    return F.try_element_at(F.transform(F.slice(F.filter(occurrences(normalize(text), _DURATION), own), 1, 1), lambda x: value(x["found"])), F.lit(1))


def education_mentions(text: Column) -> Column:
    """The credentials as they are written, in order; what stands in labelled lines of personal data is none."""
    found = F.regexp_extract_all(without_sensitive_lines(text), F.lit(rf"(?i)(?<!\w)(?:{'|'.join(X.CREDENTIALS)})(?!\w)"), 0)
    return F.transform(found, collapse)


def education_levels(text: Column, levels: Mapping[str, str]) -> Column:
    """The labels of ``levels`` (label to pattern) whose pattern occurs, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(k)) for k, p in levels.items()]))


# The four canonical levels.
EDUCATION = {
    "Doctorate": r"\b(?:ph\.?d|doctor(?:ate)?|doktor|s3)\b",
    "Master": r"\b(?:master(?:'s)?|magister|m\.?sc|mba|s2)\b",
    "Bachelor": r"\b(?:bachelor(?:'s)?|sarjana|b\.?sc|s1)\b",
    "Diploma": r"\b(?:diploma|d3|d4|associate)\b",
}


def tokenize(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Retrieval tokens: runs of a-z 0-9 + # . / -, without edge punctuation but for + # and a leading dot, single characters only if c, r or a digit.

    ``stop_words`` are left out; signal words and technical terms should not be among them.
    """
    raw = F.regexp_extract_all(normalize(text), F.lit(r"([a-z0-9+#./-]+)"), 1)
    clean = F.transform(raw, lambda t: F.regexp_replace(t, r"^[/-]+|[./-]+$", ""))
    keep = F.filter(clean, lambda t: (F.length(t) > 1) | t.rlike("^[cr0-9]$"))
    return F.filter(keep, lambda t: ~t.isin(*stop_words)) if stop_words else keep


def split_sentences(text: Column, least: int = 5) -> Column:
    """Sentences by full stops, line ends and bullets; blanks collapsed, shorter than ``least`` left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+|[•\-*]\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: F.length(s) >= least)


def normalize_role(role: Column) -> Column:
    r = F.translate(F.lower(F.trim(role)), " -", "__")
    return F.when(r.isin("rec", "recruiter"), "recruiter").when(r.isin("hm", "hiring_manager"), "hiring_manager").otherwise(r)


def parse_criterion(line: Column) -> Column:
    """``required: label`` and the like as a struct (label, type); a line without a marker is required."""
    marked = r"(?i)^\s*(wajib|required|diutamakan|preferred)\s*[|:]\s*(.+?)\s*$"
    kind = F.lower(F.regexp_extract(line, marked, 1))
    label = F.when(kind != "", F.regexp_extract(line, marked, 2)).otherwise(F.trim(line))
    return F.struct(label.alias("label"), F.when(kind.isin("diutamakan", "preferred"), "preferred").otherwise("required").alias("type"))


def valid_score(value: Column) -> Column:
    """A whole number from 1 to 5 (also written 4.0); null for anything else."""
    v = value.cast("string").try_cast("double")
    return F.when((v == F.floor(v)) & v.between(1, 5), v.cast("int"))


def safe_slug(text: Column, limit: int = 30) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), 1, limit)


def seal(*parts: Column, prefix: str = "SEAL") -> Column:
    """A short checksum of the parts joined by colons: PREFIX-xxxx-xxxx-xxxx."""
    h = F.upper(F.sha2(F.concat_ws(":", *parts), 256))
    return F.concat_ws("-", F.lit(prefix), F.substring(h, 1, 4), F.substring(h, 5, 4), F.substring(h, 9, 4))


def contains_text(query: str, *columns: Column) -> Column:
    """Case-insensitive search over several columns; a null column holds nothing."""
    hits = [F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
