"""Column expressions on text: normalisation, segments, extraction of JSON, search predicates."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations of organisation words and what they stand for, in the order they are applied.
ABBREVIATIONS = (
    ("univ", "university"), ("univers", "university"), ("inst", "institute"), ("dept", "department"), ("ctr", "center"),
    ("centre", "center"), ("hosp", "hospital"), ("natl", "national"), ("acad", "academy"), ("sci", "sciences"),
    ("med", "medical"), ("tech", "technology"), ("coll", "college"), ("lab", "laboratory"), ("res", "research"),
)
# Words that mark a segment as an organisation, and beginnings that mark it as a part of one.
ORG_WORDS = (
    "university institute hospital college center academy school laboratory foundation council company inc ltd gmbh "
    "corporation agency ministry universite universidad universitat universita universidade klinikum clinic"
).split()
PART_PREFIXES = ("department", "division", "faculty", "unit", "section", "program")


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition, then every character beyond ASCII dropped (so 'ø' vanishes, 'é' becomes 'e').

    There is no built-in for the decomposition; this is the one Arrow UDF of the
    cascade.  It is declared non-deterministic (which it is not) so that filters
    on what is computed from it are not pushed below it and evaluated twice.
    """
    return _ascii.asNondeterministic()(c)


_JUNK, _SHORT, _BLANKS = re.compile("[^a-z0-9, ]+"), re.compile(rf"\b({'|'.join(a for a, _ in ABBREVIATIONS)})\b"), re.compile(r"\s+")


def normalized(s: str) -> str:
    """The normal form of one string; no abbreviation's expansion is another abbreviation, so one pass does for all."""
    full = dict(ABBREVIATIONS)
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return _BLANKS.sub(" ", _SHORT.sub(lambda m: full[m[1]], _JUNK.sub(" ", s))).strip(" ,")


@F.pandas_udf(T.StringType())
def _normalized(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalized(x))


def normalize_org(c: Column) -> Column:
    """Folded, lower-case text of a-z, 0-9, commas and single blanks with abbreviations written out.

    As the decomposition needs Python anyway, the whole form is made in the same
    Arrow pass rather than by seventeen regular expressions around it.
    """
    return _normalized.asNondeterministic()(c)


def org_segments(norm: Column) -> Column:
    """Comma segments that name an organisation; the first two segments where none does."""
    segs = F.filter(F.transform(F.split(norm, ","), lambda x: F.trim(x)), lambda x: x != "")
    words = F.array(*map(F.lit, ORG_WORDS))

    def names_org(s: Column) -> Column:
        part = reduce(lambda a, p: a | s.startswith(p), PART_PREFIXES[1:], s.startswith(PART_PREFIXES[0]))
        return F.arrays_overlap(F.split(s, " "), words) & ~part

    kept = F.filter(segs, names_org)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(segs, 1, 2))


def json_object(text: Column) -> Column:
    """From the first '{' to the last '}' of a text; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def mentions_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds any of the terms, whatever their case."""
    low = F.lower(text)
    return reduce(lambda a, t: a | low.contains(t.lower()), terms[1:], low.contains(terms[0].lower()))


def search_filter(text: Column, groups: list[list[str]]) -> Column:
    """(a or b) and (c or d): one of each group must be mentioned."""
    return reduce(lambda a, g: a & mentions_any(text, g), groups[1:], mentions_any(text, groups[0]))


def search_expression(groups: list[list[str]]) -> str:
    """The same filter as a search string for a remote source."""
    quoted = [" OR ".join(f'"{term}"' for term in group) for group in groups]
    return " AND ".join(f"({q})" for q in quoted)


def source_filter(groups: list[list[str]], types: list[str] | None = None, years: tuple[int, int] | int | None = None) -> str:
    """A remote source's whole filter: the text search, and if given the year or range of years and the work types."""
    out = f"title_and_abstract.search:{search_expression(groups)}"
    if years is not None:
        out += f",publication_year:{years}" if isinstance(years, int) else f",publication_year:{years[0]}-{years[1]}"
    if types:
        out += f",type:{'|'.join(types)}"
    return out


def corpus_filter(text: Column, groups: list[list[str]], kind: Column, types: list[str], year: Column, years: tuple[int, int]) -> Column:
    """The same filter as a predicate on a table's columns."""
    return search_filter(text, groups) & kind.isin(types) & year.between(*years)


def clip(c: Column, n: int) -> Column:
    """The first n characters, right-trimmed."""
    return F.rtrim(F.substring(c, 1, n))


def map_or_self(c: Column, names: dict[str, str]) -> Column:
    """The value's name where it has one, else the value."""
    if not names:
        return c
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)
