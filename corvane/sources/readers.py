"""Sources: plain text, Word documents, strict CSV, JSON manifests, packet files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import lines

LINE_SCHEMA = "path string, page int, line_no int, line string, error string"
MAX_LINES, MAX_CHARS = 20_000, 1_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files as lines: UTF-8 with replacement, page 1; a file over the limits is one row with an error."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    parts = raw.select("path", lines(F.regexp_replace("text", "^﻿", "")).alias("ls"), F.length("text").alias("n"))
    bad = F.when(F.col("n") > MAX_CHARS, "too many characters").when(F.size("ls") > MAX_LINES, "too many lines")
    rows = parts.select("path", F.when(bad.isNull(), F.col("ls")).otherwise(F.array()).alias("ls"), bad.alias("error"))
    return rows.select("path", F.lit(1).alias("page"), F.posexplode_outer("ls").alias("line_no", "line"), "error")


def _docx(content: bytes) -> list[str]:
    """Paragraphs and table rows (cells joined by bars, merged cells once) of a package, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > 2000 or sum(i.file_size for i in infos) > 32 << 20:
            raise ValueError("package too large")
        if not {"[Content_Types].xml", "word/document.xml"} <= {i.filename for i in infos}:
            raise ValueError("not a document package")
        xml = z.read("word/document.xml")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("document types are not allowed")
    words = lambda p: "".join("\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else t.text or "" for t in p.iter() if t.tag in (_W + "t", _W + "tab", _W + "br"))

    def walk(node: ElementTree.Element) -> Iterator[str]:
        for x in node:
            if x.tag == _W + "p":
                yield words(x)
            elif x.tag == _W + "tbl":
                for row in x.iter(_W + "tr"):
                    cells = [" ".join(filter(None, map(words, c.iter(_W + "p")))).strip() for c in row.findall(_W + "tc")]
                    yield " | ".join(dict.fromkeys(c for c in cells if c))

    body = ElementTree.fromstring(xml).find(_W + "body")
    return [s for t in walk(body) for s in re.split(r"\r\n|[\n\r]", t) if s.strip()] if body is not None else []


def docx_lines(spark: SparkSession, path: str) -> DataFrame:
    """Word documents as lines, page null; a broken package is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(p, None, i, s, None) for i, s in enumerate(_docx(c))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append((p, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page", "line_no", "line", "error"]).astype({"page": "Int32", "line_no": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINE_SCHEMA)


def strict_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV whose header has exactly ``columns`` (any order), all strings; too many or few cells fail the read."""
    seen = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    head = [c.lstrip("﻿") for c in seen.columns]
    if sorted(head) != sorted(columns):
        raise ValueError(f"header is {head}, not {list(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    if not seen.limit(1).count():
        raise ValueError("the file has no rows")
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", nullValue="\u0000").select(*columns)


def manifest(spark: SparkSession, path: str, pattern: str = r"^r\d{5}$", size: int | None = None) -> DataFrame:
    """A JSON array of samples with unique well-formed ids, ``size`` of them if given."""
    m = spark.read.option("multiLine", True).json(path)
    bad = m.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | ~F.coalesce(F.col("sample_id").rlike(pattern), F.lit(False)))
    if bad.limit(1).count():
        raise ValueError("sample ids must be unique and well formed")
    if size is not None and m.count() != size:
        raise ValueError(f"the manifest must hold {size} samples")
    return m


def load_samples(spark: SparkSession, samples: DataFrame, root: str, name: str = "resume_text.txt", most_bytes: int = 8 << 20) -> DataFrame:
    """The texts of a manifest's samples: sample_id, page (null), line_no, line (trimmed). All or none: a missing, empty or oversized text raises."""
    files = spark.read.format("binaryFile").load(f"{root}/*/{name}").select(F.element_at(F.split("path", "/"), -2).alias("sample_id"), "length", F.decode("content", "UTF-8").alias("text"))
    j = samples.select("sample_id").join(files, "sample_id", "left")
    bad = j.where(F.col("text").isNull() | (F.col("length") > most_bytes) | (F.regexp_replace("text", r"(?U)\s+", "") == ""))
    if bad.limit(1).count():
        raise ValueError("texts are missing, empty or too large; nothing is loaded")
    return j.select("sample_id", F.lit(None).cast("int").alias("page"), F.posexplode(F.transform(lines(F.col("text")), lambda x: F.trim(x))).alias("line_no", "line"))


def discover_samples(spark: SparkSession, root: str, manifest_path: str | None = None, pattern: str = r"^r\d{5}$") -> DataFrame:
    """Ids of samples in order: of the manifest if there is one, else of the well-formed folders under ``root``."""
    if manifest_path is not None:
        return manifest(spark, manifest_path, pattern).select("sample_id").orderBy("sample_id")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.element_at(F.split("path", "/"), -2).alias("sample_id"))
    return found.where(F.col("sample_id").rlike(pattern)).distinct().orderBy("sample_id")


def corpus_csv(spark: SparkSession, path: str, ident: str = "ID", text: str = "Resume_str", category: str = "Category") -> DataFrame:
    """A corpus in CSV with quoted texts over several lines: doc_id, text, category; other columns are not kept."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), F.col(category).alias("category"))


def expected_labels(spark: SparkSession, path: str, schema: str = "sample_id string, skills array<string>, education array<string>, experience_years double") -> DataFrame:
    """Ground truth of samples, one JSON document per file; the id is the folder's where the document has none."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("__folder"))
    return raw.withColumn("sample_id", F.coalesce("sample_id", "__folder")).drop("__folder")


def demo_rows(spark: SparkSession, rows: Sequence[tuple[str, str]], loaded: DataFrame) -> DataFrame:
    """Built-in documents (id, text) that are not among the ``loaded`` candidates yet."""
    return not_loaded(spark.createDataFrame(list(rows), "id string, text string"), loaded, "id")


def external_lines(files: DataFrame, parse: Callable[[bytes], Iterable[tuple[int | None, str]]] | None) -> DataFrame:
    """Lines of files (path, content) by a parser that the caller brings, such as for PDF pages or recognised images: ``LINE_SCHEMA``.

    ``parse`` gives (page, line) of a file's bytes and runs on the executors. What it raises, and every file without a parser or over the limits, is one row with
    an error, so that one broken file stops no job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    if parse is None:
                        raise ValueError("no parser is installed for this format")
                    found = [(p, page, i, s, None) for i, (page, s) in enumerate((page, s) for page, s in parse(c) if s.strip())]
                    if len(found) > MAX_LINES or sum(len(x[3]) for x in found) > MAX_CHARS:
                        raise ValueError("too many lines or characters")
                    out += found
                except Exception as e:  # noqa: BLE001  (a foreign parser may raise anything)
                    out.append((p, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "page", "line_no", "line", "error"]).astype({"page": "Int32", "line_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, LINE_SCHEMA)


def pdf_parser() -> Callable[[bytes], Iterable[tuple[int | None, str]]] | None:
    """A parser of PDF pages if a library for it is installed, else None."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None

    def parse(content: bytes) -> Iterable[tuple[int | None, str]]:
        pages = PdfReader(io.BytesIO(content)).pages
        if len(pages) > 40:
            raise ValueError("too many pages")
        return [(i, s) for i, page in enumerate(pages, 1) for s in re.split(r"\r\n|[\n\r]", page.extract_text() or "")]

    return parse


def page_coverage(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (path, page) with and without text: files, pages, with_text, without_text."""
    seen = lines_.where("error is null").select("path", "page").distinct().withColumn("t", F.lit(1))
    return pages.join(seen, ["path", "page"], "left").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("pages"), F.count("t").alias("with_text"), (F.count(F.lit(1)) - F.count("t")).alias("without_text"))


def round_trip(original: DataFrame, again: DataFrame, ident: str = "path") -> DataFrame:
    """Whether the lines of each document came back as they were, from two tables of ``ident``, line_no, line: ``ident``, same, lines, lines_again."""
    per = lambda df, name: df.where("line is not null").groupBy(ident).agg(F.count(F.lit(1)).alias(name), F.sum(F.xxhash64("line_no", "line").cast("decimal(38,0)")).alias(f"h_{name}"))
    j = per(original, "lines").join(per(again, "lines_again"), ident, "full_outer")
    return j.select(ident, F.coalesce((F.col("lines") == F.col("lines_again")) & (F.col("h_lines") == F.col("h_lines_again")), F.lit(False)).alias("same"), "lines", "lines_again")


# Limits of what is typed in: fixed values.
CAPS = {"title": 160, "department": 120, "description": 12_000, "reviewer": 100, "note": 2_000, "label": 180}


def capped(df: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """``df`` with its text columns trimmed and cut at their limits."""
    return df.select(*[F.substring(F.trim(c), 1, caps[c]).alias(c) if c in caps else F.col(c) for c in df.columns])


def job_rules() -> dict[str, Column]:
    """What a job must keep to be taken: a title, and one to sixty criteria with label and a known type (column criteria: array of structs)."""
    good = F.filter("criteria", lambda c: (F.coalesce(F.trim(c["label"]), F.lit("")) != "") & c["type"].isin("required", "preferred"))
    return {"title": F.trim(F.coalesce("title", F.lit(""))) != "", "criteria": F.size(good) > 0, "few_enough": F.coalesce(F.size("criteria"), F.lit(0)) <= 60}


def review_rules() -> dict[str, Column]:
    """What a review must keep: a reviewer, a known role and decision."""
    return {"reviewer": F.trim(F.coalesce("reviewer", F.lit(""))) != "", "role": F.col("role").isin("recruiter", "hiring_manager"), "decision": F.col("decision").isin("advance", "needs_info", "not_selected")}


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all ``rules``, and the others with the names of those they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    tagged = df.withColumn("violations", broken)
    return tagged.where(F.size("violations") == 0).drop("violations"), tagged.where(F.size("violations") > 0)


def not_loaded(new: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not among the loaded ones: loading twice adds nothing."""
    return new.join(loaded.select(key).distinct(), key, "left_anti")
