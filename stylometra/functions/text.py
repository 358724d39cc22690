"""Column functions on text: normalisation, words, sentences, shares of scripts, fingerprints, plural forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word is, the marks that end a sentence, and the sign that stands for a border.
WORD = r"([\p{L}\p{N}]+(?:[-’'][\p{L}\p{N}]+)*)"
ENDS = r"([.!?…]+)\s+"
BORDER = "\x1e"


def words(text: Column) -> Column:
    # The same matches without a way back, which takes a step of the stack for each part of a word.
    return F.regexp_extract_all(text, F.lit(WORD.replace("+", "++").replace(")*", ")*+")), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts that end with a mark and white space; parts without a word are left out."""
    return F.filter(F.split(F.regexp_replace(text, ENDS, f"$1{BORDER}"), BORDER), lambda s: F.size(words(s)) > 0)


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_yo(text: Column) -> Column:
    """Hyphens of other kinds and the letter yo in their plain forms; the length stays."""
    for sign, plain in zip("‐‑ёЁ", "--еЕ"):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def letters(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(rf"\p{{Is{script}}}"))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the text with plain line ends and no blanks at their ends."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+(\n|$)", "$1")
    return F.left(F.sha2(F.trim(clean).cast("binary"), 256), F.lit(16))


def piece_fingerprint(text: Column) -> Column:
    return F.left(F.sha2(collapsed(text).cast("binary"), 256), F.lit(16))


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun after a number."""
    tens, unit = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tens.between(11, 14), many).when(unit == 1, one).when(unit.between(2, 4), few).otherwise(many)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def label(score: Column) -> Column:
    return F.when(score < 15, "clean").when(score < 40, "light").when(score < 70, "marked").otherwise("heavy")
