"""Text rules as Column functions: lines, labels, references, dates, identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that results depend on.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
NAVIGATION_LINES = ["|", "back to top"]
NAVIGATION_STARTS = ["go to next", "return to previous", "return to trial toc", "return to the hadc table of contents", "return to top", "return to hadc table of contents"]
MARKER = r"^\[Image,\s*(.+?)\]"
PAGE_REF = r"(?i)Page\s+([A-Z]?\d+|[ivxlcdm]+)"
QUESTION, ANSWER, SPEAKER = r"^Q[\.\s]", r"^A[\.\s]", r"^(MR|Mr|THE COURT|WITNESS|A JUROR)[:\.\s]"
TOC_ENTRY = r"^[-*]\s+\["
NAMED_SPEAKER = r"(?m)^((?:MR|Mr|THE COURT|WITNESS|A JUROR)[^:\n]*):"
PARENTHESES = r"\s*\([^)]*\)"
PAGE = r"[A-Z]?\s?\d+(?:\s+1/2)?"
PAGE_RANGE = r"(?i)([A-Z]?\s?\d+)(?:\s+1/2)?\s*[-–]\s*([A-Z]?\s?\d+)(?:\s+1/2)?"
PAGE_LIST = r"(?i)\b(?:pp?\.?|pages?|page)\s*([A-Z]?\s?\d+(?:\s+1/2)?)"
VOLUME, PAGES = r"(?i)Volume\s+([A-Z]+|[IVXLCDM]+)", r"(?i)(?:pages?|Volume\s+[A-Z]+,)\s+([ivxlcdm\d -]+)"
DATE_TEXT, WITNESS = r"(1886\s+[A-Z][a-z]+\s+\d{1,2}|[A-Z][a-z]+\s+\d{1,2},\s+1886)", r"Testimony of ([^,\n]+)"

YEAR_FIRST, YEAR_LAST = r"(\d{4})\s+([A-Za-z]+)\.?\s+(\d{1,2})", r"([A-Za-z]+)\.?\s+(\d{1,2}),\s*(\d{4})"
TESTIMONY_TERMS = ["testimony", "direct examination", "cross-examination"]
LEGAL_TERMS = ["summons", "motion", "order", "indictment"]
MARKER_LINE = r"^\[Image,\s*.+?\]$"


def or_null(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return or_null(F.regexp_extract(c, pattern, group))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """The collapsed lines of a text that aren't empty, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), LINE_END), lambda x: collapse(x)), lambda x: x != "")


def normalize_text(c: Column) -> Column:
    return F.array_join(lines(c), "\n")


def is_navigation(line: Column) -> Column:
    low, out = F.lower(F.trim(line)), F.lit(False)
    for start in NAVIGATION_STARTS:
        out |= low.startswith(start)
    return low.isin(NAVIGATION_LINES) | out


def marker_label(line: Column) -> Column:
    return found(line, MARKER)


def page_ref(label: Column) -> Column:
    return found(label, PAGE_REF)


def classify_line(line: Column) -> Column:
    kinds = [("question", line.rlike(QUESTION)), ("answer", line.rlike(ANSWER)), ("speaker", line.rlike(SPEAKER)), ("reference", line.startswith("[") & line.endswith("]")), ("toc_entry", line.rlike(TOC_ENTRY))]
    return F.coalesce(*(F.when(test, kind) for kind, test in kinds), F.lit("text"))


def normalize_label(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def label_variants(c: Column) -> Column:
    """The normalized label, and that without what stands in parentheses; empty ones left out."""
    whole = normalize_label(c)
    return F.filter(F.array_distinct(F.array(whole, normalize_label(F.regexp_replace(whole, PARENTHESES, "")))), lambda x: x != "")


def strip_ref(c: Column) -> Column:
    return or_null(F.regexp_replace(F.trim(c), "^#+", ""))


def parse_date(c: Column) -> Column:
    """ISO date of the first `1886 July 16` in a text, else of the first `July 16, 1886`, months long or short; or null."""
    text = F.replace(F.replace(F.trim(c), F.lit("Sept."), F.lit("Sep.")), F.lit("August"), F.lit("Aug."))
    year_first = F.concat_ws(" ", *(found(text, YEAR_FIRST, i) for i in (1, 2, 3)))
    year_last = F.concat_ws(" ", *(found(text, YEAR_LAST, i) for i in (3, 1, 2)))
    tries = [F.try_to_timestamp(x, F.lit(f)) for x in (year_first, year_last) for f in ("yyyy MMMM d", "yyyy MMM d")]
    return F.coalesce(*tries).cast("date").cast("string")


def page_number(c: Column) -> Column:
    return found(c, r"\d+", 0).try_cast("int")


def page_range(c: Column) -> Column:
    """(start, end) of the first range of pages, or of a text that is one page; nulls otherwise."""
    only = F.when(F.trim(c).rlike(f"(?i)^{PAGE}$"), page_number(c))
    return F.struct(F.coalesce(page_number(found(c, PAGE_RANGE, 1)), only).alias("start"), F.coalesce(page_number(found(c, PAGE_RANGE, 2)), only).alias("end"))


def number_range(c: Column) -> Column:
    """(start, end): the first and last whole number anywhere."""
    every = F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    return F.struct(F.try_element_at(every, F.lit(1)).cast("int").alias("start"), F.try_element_at(every, F.lit(-1)).cast("int").alias("end"))


def page_refs(c: Column) -> Column:
    """Distinct page references in order: the starts in page lists; else the start of a bare range, or the value itself."""
    listed = F.transform(F.regexp_extract_all(c, F.lit(PAGE_LIST), 1), lambda x: collapse(x))
    bare = collapse(F.coalesce(found(F.trim(c), f"(?i)^({PAGE})\\s*[-–]\\s*{PAGE}$"), c))
    return F.when(F.size(listed) > 0, F.array_distinct(listed)).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))


def page_refs_of(values: Column) -> Column:
    """The distinct references of several values, in order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: page_refs(x))))


def contains_any(c: Column, terms: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t)), F.lit(False))


def classify_source(url: Column, title: Column, text: Column) -> Column:
    """toc, exhibit, testimony or transcript, the first that fits."""
    link, name, near = F.lower(url), F.lower(title), F.lower(F.concat_ws(" ", url, title, F.substring(text, 1, 500)))
    return F.when(link.contains("trialtoc") | name.contains("table of contents"), "toc").when(link.contains("/exhibits/") | name.contains("exhibit"), "exhibit").when(contains_any(near, TESTIMONY_TERMS), "testimony").otherwise("transcript")


def document_role(kind: Column, title: Column) -> Column:
    """What a document is, by its source type and then its title."""
    name = F.lower(F.coalesce(title, F.lit("")))
    return F.when(kind.isin("testimony", "exhibit", "toc"), kind).when(name.contains("cover page"), "cover").when(contains_any(name, LEGAL_TERMS), "legal_document").otherwise("other")


def metadata(url: Column, title: Column, text: Column) -> Column:
    return F.struct(found(text, VOLUME).alias("volume"), or_null(F.trim(found(text, PAGES))).alias("pages"), found(text, DATE_TEXT).alias("date_text"), F.trim(found(title, WITNESS)).alias("witness_name"), F.substring_index(url, "/hadc/", -1).alias("url_path"))


def named_speakers(c: Column, most: int = 25) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NAMED_SPEAKER), 1), lambda x: F.trim(x)))), 1, most)


def cache_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by bars; a null part is an empty one."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() if x is not None else None)


def slug(c: Column, prefix: str | None = None) -> Column:
    """ASCII letters and digits in lower case, joined by underscores; `unknown` if none is left. Every row passes through the
    vectorised fold, which leaves ASCII as it is."""
    name = F.lower(F.regexp_replace(F.regexp_replace(_fold(c), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    name = F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)
    return F.concat(F.lit(f"{prefix}_"), name) if prefix else name


def source_id(url: Column) -> Column:
    return slug(F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.html?$", ""), "source_hadc")
