"""Text clean-up of the metadata layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_kind(source_type: Column) -> Column:
    """journal, conference, or null for any other type."""
    s = F.trim(F.regexp_replace(F.replace(F.lower(source_type), F.lit("&"), F.lit("and")), r"(?U)\s+", " "))
    return F.when(s == "journal", F.lit("journal")).when(s.isin("conference and proceedings", "conference proceedings"), F.lit("conference"))


def text_or_title(abstract: Column, name: Column) -> Column:
    """The abstract, else the name; blanks (spaces only) count as missing."""
    filled = lambda c: F.nullif(F.btrim(c), F.lit(""))
    return F.coalesce(filled(abstract), filled(name))


def without_placeholder(text: Column, placeholder: str) -> Column:
    """The text, or nothing where it is null or, but for white space around it, the placeholder."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(text.isNull() | (bare == placeholder), F.lit("")).otherwise(text)


def model_label(stem: Column, prefix: str) -> Column:
    """A model's file stem without its prefix."""
    return F.regexp_replace(stem, "^" + prefix + "_", "")
