"""Sentences that know abbreviations, initials, closing quotes and ends of lines: one pattern, for Spark and for tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BORDER, words

# Words after which a full stop doesn't end a sentence.
ABBREVIATIONS = (
    "т е д п г гг в вв с см рис табл др им ул проф акад вып стр ст н э тыс млн млрд руб коп мин сек ч кв обл "
    "ред изд пер сб т.е т.д т.п т.к etc et al no vol pp fig eq doi проч напр прим ср англ лат гл"
).split()
BLANK = r"[\s\p{Z}]"
MARKS = '[.!?…]+["»”)]*'
SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
# What may stand before the capital or digit of the next sentence, and what a line begins with that ends one.
OPENS = '["«„(—–-]'
LINE = r"[ \t]*(?:\n|[-*+•][ \t]|[0-9]+[.)][ \t]|[>|])"
END = rf"(?<![.!?…])(?<!\p{{Lu}})(?<!(?<![\p{{L}}.])(?iu:{SHORT})){MARKS}(?={BLANK}++(?:{OPENS}{BLANK}*+)?[\p{{Lu}}0-9])|\n(?={LINE})"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def sentences(text: Column) -> Column:
    """Sentences without blanks around them; those without a word are left out. Null gives null."""
    parts = F.split(F.regexp_replace(text, END, f"$0{BORDER}"), BORDER)
    return F.filter(F.transform(parts, trimmed), lambda s: F.size(words(s)) > 0)
