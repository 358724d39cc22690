"""Column functions on spans: blanking what patterns match, and the place of an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blanked(text: Column, pattern: str) -> Column:
    """text with all matches turned into blanks; line breaks and the length stay, so offsets keep their meaning."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = lambda gap, hit: F.concat(gap, F.coalesce(F.regexp_replace(hit, "[^\n]", " "), F.lit("")))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), hits, joined), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def line(text: Column, start: Column) -> Column:
    """The line of an offset, from 1."""
    return F.regexp_count(F.left(text, start), F.lit("\n")).cast("long") + 1


def column(text: Column, start: Column) -> Column:
    """The place of an offset in its line, from 1."""
    return F.length(F.substring_index(F.left(text, start), "\n", -1)).cast("long") + 1
