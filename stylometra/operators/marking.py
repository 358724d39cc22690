"""Highlighted pieces of a report, found again in their document: spans, marked fragments and paragraphs, samples.

A piece is copied from a report, so line breaks, markup, quote marks and slips of a text layer differ. It is located by
its first and last words. Everything is computed in the row of a document, in Arrow batches: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import fragments as G
from .rows import sliced, small_batches

# Words a piece must have, words of a piece's ends that are sought (longest first), how much longer than the
# piece its place may be, the share of words that marks a fragment.
LEAST_PIECE, ENDS, FACTOR, MARGIN, SHARE = 5, (6, 5, 4, 3), 1.5, 20, 0.5
# When a marked paragraph counts as unedited, its least words, and what begins a paragraph that isn't prose.
SAME, LEAST_PARAGRAPH, NOT_PROSE = 0.98, 15, ("#", "<", "![", "|")
#: product of two lengths up to which texts are compared character by character
LONG_RANGE = 40_000
WORD = re.compile(r"[^\W_]+")
PARAGRAPH = re.compile(r"[^\n](?:[^\n]|\n(?![ \t]*\n))*")
SPANS = "array<struct<piece:int,start:bigint,end:bigint>>"
MARKED = "fragment int, start long, end long, coverage double, holds_piece boolean, marked boolean, text string"
UNEDITED = "start long, line long, similarity double, text string"


class Words:
    """The words of a text in plain lower case, with their places and an index of each three that follow each other."""

    def __init__(self, text: str):
        found = [*WORD.finditer(text)]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.words = [m.group().lower().replace("ё", "е") for m in found]
        self.index: dict[tuple, list[int]] | None = None

    def at(self, probe: list[str]) -> list[int]:
        """The places of some three words or more, ascending."""
        if self.index is None:
            self.index = {}
            for k, three in enumerate(zip(self.words, self.words[1:], self.words[2:])):
                self.index.setdefault(three, []).append(k)
        found = self.index.get(tuple(probe[:3]), [])
        return found if len(probe) == 3 else [k for k in found if self.words[k : k + len(probe)] == probe]


def located(document: Words, piece: list[str]) -> tuple[int, int] | None:
    """First and last word of a piece in a document, None if it can't be found.

    The beginning may occur before the piece itself, as a heading does in a table of contents: places are tried in order
    until the piece's end follows near enough. If it never does, only as many words as the piece has count, from the
    first place on.
    """
    if len(piece) < LEAST_PIECE:
        return None
    tails = [(k, document.at(piece[-k:])) for k in ENDS if len(piece) >= k]
    first, least = None, 0
    for k in ENDS:
        if len(piece) < k:
            continue
        begins = document.at(piece[:k])
        for begin in begins[bisect_left(begins, least) :]:
            first = begin if first is None else first
            end = next((places[i] + n - 1 for n, places in tails if (i := bisect_left(places, begin)) < len(places)), None)
            if end is not None and end - begin + 1 <= len(piece) * FACTOR + MARGIN:
                return begin, end
            least = begin + 1
    return None if first is None else (first, min(first + len(piece), len(document.words)) - 1)


def spans_of(document: Words, pieces: list[str | None]) -> list[tuple[int, int, int]]:
    """(piece, start, end) of the pieces found."""
    found = ((n, located(document, Words(p).words)) for n, p in enumerate(pieces) if p)
    return [(n, document.starts[x[0]], document.ends[x[1]]) for n, x in found if x]


class Cover:
    """How much of a document's words spans cover; sums over prefixes, so that any range costs two searches."""

    def __init__(self, document: Words, spans: list[tuple[int, int, int]]):
        self.starts = np.array(document.starts, np.int64)
        change = np.zeros(len(self.starts) + 1, np.int64)
        for _, a, z in spans:
            change[np.searchsorted(self.starts, a)] += 1
            change[np.searchsorted(self.starts, z)] -= 1
        self.before = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        # of the spans that begin at a place or later, the one that ends first tells whether a range holds any
        self.spans = sorted((a, z) for _, a, z in spans)
        self.first_end = [*np.minimum.accumulate([z for _, z in reversed(self.spans)])[::-1]] if self.spans else []

    def of(self, start: int, end: int) -> tuple[int, int, bool]:
        """Words of a range, those of them covered, and whether a whole span lies in it."""
        a, z = np.searchsorted(self.starts, [start, end])
        k = bisect_left(self.spans, (start, -1))
        return int(z - a), int(self.before[z] - self.before[a]), k < len(self.spans) and bool(self.first_end[k] <= end)


def _in_rows(df: DataFrame, columns: list[str], schema: str, found) -> DataFrame:
    """The other columns of df, and a row for each tuple that found(*values of columns) gives."""
    import pyarrow as pa

    others = [c for c in df.columns if c not in columns]
    taken = {c.split()[0] for c in schema.split(", ")} & set(others)
    if taken:
        raise ValueError(f"columns of these names are made here: {sorted(taken)}")
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    names, types = zip(*((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")))

    def run(batches):
        for kept, out in sliced(batches, len(columns), found):
            yield pa.record_batch([*kept, *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=[*others, *names])

    ordered = small_batches(df).select(*others, *columns)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[: len(others)]]
    return ordered.mapInArrow(run, ", ".join([*kept, schema]))


def marked_spans(df: DataFrame, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """A row per piece found: the other columns, piece (from 0), start and end in code points. Pieces of fewer than five
    words, null and empty ones aren't sought; a null text has none."""
    return _in_rows(df, [text, pieces], "piece int, start long, end long", lambda t, p: spans_of(Words(t or ""), p or []))


def marked_fragments(df: DataFrame, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """Every fragment of a text with the share of its words that pieces cover, whether it holds a piece, and whether it
    counts as marked: it holds one, or at least half of its words are covered."""

    def found(t, p):
        document = Words(t or "")
        cover = Cover(document, spans_of(document, p or []))
        for n, (a, z, _, whole) in enumerate(G.packed(t or "")):
            words, covered, holds = cover.of(a, z)
            share = covered / words if words else 0.0
            yield n, a, z, share, holds, holds or share >= SHARE, whole

    return _in_rows(df, [text, pieces], MARKED, found)


def label_samples(df: DataFrame, rare: str, signals: Column, clerical: Column, doc: Column, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """doc, part, f, y: a sample for each fragment of the texts, labelled by the pieces. `part` is the fingerprint of the
    fragment, the same for any blanks and line breaks; rare, signals and clerical are those of fragments.measured."""
    rows = marked_fragments(df.select(text, pieces, doc.alias("doc")), pieces, text)
    rows = rows.select("doc", "text", F.col("marked").cast("int").alias("y"), T.piece_fingerprint(F.col("text")).alias("part"))
    features = G.features(G.measured(rows, rare, signals, clerical), "doc", "part", "y")
    return features.select("doc", "part", F.array(*G.NAMES).alias("f"), "y")


def plain(paragraph: str) -> str:
    """Special blanks and hyphens as plain ones, runs of blanks as one."""
    return " ".join(paragraph.replace("‐", "-").replace("‑", "-").split())


def may_match(a: str, b: str) -> bool:
    """False only where the ratio of two texts can't reach SAME: then at most `most` characters are in one of them alone,
    so that of `most` + 1 parts of the first text one at least is whole in the other, moved by at most as many places."""
    most = int((1 - SAME) * (len(a) + len(b)) + 1e-6)
    bounds = [len(a) * k // (most + 1) for k in range(most + 2)]
    return any(b.find(a[i:j], max(0, i - most), j + most) >= 0 for i, j in zip(bounds, bounds[1:]))


def matching(a: str, b: str) -> int:
    """Characters that SequenceMatcher's blocks of two texts hold: the longest common part, the first one in a and in b,
    and what is left and right of it in the same way. In long ranges its length is found by bisection over hashes of
    parts, so time grows with the texts instead of with their product; a part found is compared, and a range where hashes
    collide goes to SequenceMatcher."""
    code = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for x in (a, b)]
    n = max(len(a), len(b)) + 1
    power = np.full(n, np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    power = np.cumprod(power)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[: len(c)])]) for c in code]
    # hashes of a and of b are alike where their powers are brought to the same place
    hashes = lambda side, lo, hi, size: (sums[side][lo + size : hi + 1] - sums[side][lo : hi + 1 - size]) * power[n - 1 - np.arange(lo, hi + 1 - size)]
    total, open_ = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while open_:
        alo, ahi, blo, bhi, most = open_.pop()
        most = min(most, ahi - alo, bhi - blo)
        if most <= 0:
            continue
        if (ahi - alo) * (bhi - blo) > LONG_RANGE:
            least = 0
            while least < most:
                size = (least + most + 1) // 2
                if np.isin(hashes(0, alo, ahi, size), hashes(1, blo, bhi, size)).any():
                    least = size
                else:
                    most = size - 1
            if not least:
                continue
            left, right = hashes(0, alo, ahi, least), hashes(1, blo, bhi, least)
            i = int(np.isin(left, right).argmax())
            j = blo + int((right == left[i]).argmax())
            i += alo
            if a[i : i + least] == b[j : j + least]:
                total += least
                open_ += [(alo, i, blo, j, least), (i + least, ahi, j + least, bhi, least)]
                continue
        total += sum(x.size for x in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
    return total


def likeness(paragraph: str, others: list[str], lengths: list[int], known: set[str]) -> float:
    """The largest ratio of matching characters to any of the others (sorted by length), 0 where none reaches SAME.

    A ratio is at most 2 min / (a + b) of two lengths, so only others of nearly the same length are compared."""
    if paragraph in known:
        return 1.0
    n, best = len(paragraph), 0.0
    for other in others[bisect_left(lengths, int(n * SAME / (2 - SAME)) - 1) : bisect_right(lengths, int(n * (2 - SAME) / SAME) + 2)]:
        if not may_match(paragraph, other):
            continue
        matcher = SequenceMatcher(None, paragraph, other, autojunk=False)
        if matcher.real_quick_ratio() >= SAME and matcher.quick_ratio() >= max(SAME, best):
            best = max(best, 2.0 * matching(paragraph, other) / (n + len(other)))
    return best if best >= SAME else 0.0


def unedited(df: DataFrame, before: str = "before", after: str = "after", pieces: str = "pieces") -> DataFrame:
    """Paragraphs of prose under a highlight that an edit left as they were: start, line, similarity, text. Changed blanks
    and hyphens are no edit; short paragraphs, headings, markup and tables aren't judged."""

    def found(b, a, p):
        document = Words(b or "")
        cover = Cover(document, spans_of(document, p or []))
        others = sorted((plain(m.group()) for m in PARAGRAPH.finditer(a or "")), key=len)
        lengths, known = [len(x) for x in others], {*others}
        for m in PARAGRAPH.finditer(b or ""):
            words, covered, holds = cover.of(*m.span())
            if words < LEAST_PARAGRAPH or m.group().lstrip().startswith(NOT_PROSE) or not (holds or covered >= SHARE * words):
                continue
            if similarity := likeness(text := plain(m.group()), others, lengths, known):
                yield m.start(), b.count("\n", 0, m.start()) + 1, similarity, text

    return _in_rows(df, [before, after, pieces], UNEDITED, found)
