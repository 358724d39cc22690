"""A dictionary engine: phrases in a small language, rules by mode with densities and exemptions, proximity, clusters.

A phrase is tokens between blanks; `*` stands for any letters, `(a|b)` for either, `(a)?` for what may be missing, with its
blank. Phrases match whole words in any case. Dictionaries are tables of the user; the ones the queries use are small and
our own. All phrases of a dictionary are one trie of tokens, and a text is walked once, whatever the number of entries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import accumulate, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import sliced, small_batches

BLANK, LETTERS, NOT_WORD = "[ \t\n\xa0]+", r"\p{L}*", r"(?:^|[^\p{L}\p{N}_])"
#: what a phrase may hold between two words that follow each other without a blank
WORD = re.compile(r"\w+")
HITS = "grp string, phrase string, start long, text string"


def phrase(text: str) -> str:
    """The pattern of a phrase; the same in Java's and RE2's syntax, without the flag for case and without borders."""
    tokens = [x.replace("*", LETTERS).replace("(", "(?:") for x in text.split()]
    whole = "".join(f"(?:{t.removesuffix('?')}{BLANK})?" if t.endswith(")?") else t + BLANK for t in tokens[:-1])
    return whole + tokens[-1]


@dataclass(frozen=True)
class Entry:
    """group and phrase; modes in which it is skipped; least hits per 1000 words by mode ('' for all others).

    A hit counts only if one of the phrases `near` is among the `within` words before or after it, and none of `unless`.
    """

    group: str
    text: str
    severity: str = "P2"
    skip: tuple[str, ...] = ()
    density: dict[str, int] = field(default_factory=dict, hash=False, compare=False)
    near: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    within: int = 5

    @property
    def pattern(self) -> str:
        return phrase(self.text)


def applies(entry: Entry, mode: str, chat_groups: tuple[str, ...] = ("calque",)) -> bool:
    """Whether a rule is used in a mode: chat keeps graver rules and some groups only."""
    return mode not in entry.skip and (mode != "chat" or entry.severity == "P0" or entry.group in chat_groups)


def variants(text: str) -> list[list[str]]:
    """The token lists of a phrase: alternatives and missing tokens written out, `*` left at the ends of tokens."""
    tokens = []
    for token in text.split():
        if token.endswith(")?"):
            tokens.append([*("".join(x) for x in product(*_choices(token[:-1]))), None])
        else:
            tokens.append(["".join(x) for x in product(*_choices(token))])
    return [[t for t in x if t is not None] for x in product(*tokens)]


def _choices(token: str) -> list[list[str]]:
    """Of a token the parts outside of brackets as they are, those inside as alternatives; `(a)?` within a token may be missing."""
    parts = re.findall(r"\(([^()]*)\)(\??)|([^()]+)", token)
    return [[plain] if plain else [*inside.split("|"), *([""] if maybe else [])] for inside, maybe, plain in parts]


class Node:
    """Where a token leads: by the sign before it (None: blanks), then by the whole word, by its beginning or by a pattern."""

    __slots__ = ("ends", "next")

    def __init__(self):
        self.ends: list[int] = []
        self.next: dict[str | None, Edges] = {}

    def edges(self, gap: str | None) -> Edges:
        return self.next.setdefault(gap, Edges())


class Edges:
    __slots__ = ("words", "starts", "lengths", "patterns")

    def __init__(self):
        self.words, self.starts, self.lengths, self.patterns = {}, {}, [], {}

    def to(self, token: str) -> Node:
        if "*" not in token:
            return self.words.setdefault(token, Node())
        if token.endswith("*") and "*" not in token[:-1]:
            self.lengths = sorted({*self.lengths, len(token) - 1})
            return self.starts.setdefault(token[:-1], Node())
        return self.patterns.setdefault(token, (re.compile(r"[^\W\d_]*".join(map(re.escape, token.split("*")))), Node()))[1]

    def of(self, word: str):
        if (node := self.words.get(word)) is not None:
            yield node
        for n in self.lengths:
            if n > len(word):
                break
            if (node := self.starts.get(word[:n])) is not None and (n == len(word) or word[n:].isalpha()):
                yield node
        for pattern, node in self.patterns.values():
            if pattern.fullmatch(word):
                yield node


class Matcher:
    """All phrases as one trie."""

    def __init__(self, phrases: list[str]):
        self.root = Node()
        for k, text in enumerate(phrases):
            for tokens in variants(text.lower()):
                node, gap = self.root, None
                for token in tokens:
                    # a token with signs inside is several words with these signs between them
                    for word, sign in re.findall(r"([\w*]+)([^\w*]*)", token):
                        node, gap = node.edges(gap).to(word), sign or None
                    gap = None
                node.ends.append(k)

    def find(self, text: str) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """(phrase, start, end, first word, last word) of all matches, and the number of words. Matches of one phrase
        don't overlap: the first one and of it the longest counts."""
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:z].lower() for a, z in spans]
        free, out, blanks = {}, [], " \t\n\u00a0"
        roots = self.root.edges(None)
        for i, word in enumerate(words):
            nodes, at, best = [*roots.of(word)], i, {}
            while nodes:
                for node in nodes:
                    for k in node.ends:
                        if free.get(k, 0) <= i:
                            best[k] = at
                if at + 1 == len(words):
                    break
                gap = text[spans[at][1] : spans[at + 1][0]]
                gap = gap if gap.strip(blanks) else None
                at += 1
                nodes = [n for node in nodes if gap in node.next for n in node.next[gap].of(words[at])]
            for k, last in best.items():
                free[k] = last + 1
                out.append((k, spans[i][0], spans[last][1], i, last))
        return out, len(words)


def judged(entries: list[Entry], exempt: tuple[str, ...] = ()):
    """A function from a text and its number of words to (entry, start, text) of the hits that count."""
    beside = [*dict.fromkeys([*exempt, *(p for e in entries for p in (*e.near, *e.unless))])]
    matcher, number = Matcher([*(e.text for e in entries), *beside]), {p: len(entries) + k for k, p in enumerate(beside)}

    def found(text: str, n_words: int, mode: str) -> list[tuple[Entry, int, str]]:
        from bisect import bisect_left

        hits: dict[int, list[tuple]] = {}
        for k, *hit in matcher.find(text)[0]:
            hits.setdefault(k, []).append(hit)
        ranges = sorted((a, z) for p in exempt for a, z, _, _ in hits.get(number[p], ()))
        longest = [*accumulate((z for _, z in ranges), max)]
        places = {p: [i for _, _, i, _ in hits.get(number[p], ())] for e in entries for p in (*e.near, *e.unless)}
        ends = {p: [j for _, _, _, j in hits.get(number[p], ())] for p in places}

        def free(a: int, z: int) -> bool:
            k = bisect_left(ranges, (z, -1))
            return not k or longest[k - 1] <= a

        def beside_it(phrases: tuple[str, ...], i: int, j: int, within: int) -> bool:
            """Whether a phrase begins among the words after a hit or ends among those before it."""
            after = lambda p: (k := bisect_left(places[p], j + 1)) < len(places[p]) and places[p][k] <= j + within
            before = lambda p: (k := bisect_left(ends[p], i)) > 0 and ends[p][k - 1] >= i - within
            return any(after(p) or before(p) for p in phrases)

        out = []
        for k, e in enumerate(entries):
            some = [h for h in hits.get(k, ()) if free(h[0], h[1]) and not beside_it(e.unless, h[2], h[3], e.within) and (not e.near or beside_it(e.near, h[2], h[3], e.within))]
            if some and len(some) * 1000 >= n_words * e.density.get(mode, e.density.get("", 0)):
                out += [(e, a, text[a:z]) for a, z, _, _ in some]
        return out

    return found


def dictionary_hits(docs: DataFrame, entries: list[Entry], mode: str, n_words: Column, exempt: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """doc_id, grp, phrase, start, text of all rules of a mode whose density is reached; what overlaps an exempt phrase is
    left out before densities are taken. One walk over the words of each text, in Arrow batches; no shuffle. Null texts
    have no hits, and rows of one id are judged apart."""
    used = [e for e in entries if applies(e, mode)]

    def run(batches):
        import pyarrow as pa

        found = judged(used, exempt)
        hits = lambda text, n: ((e.group, e.text, start, hit) for e, start, hit in (found(text, n, mode) if text else ()))
        for kept, out in sliced(batches, 2, hits):
            yield pa.record_batch([*kept, *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string())))], names=["doc_id", "grp", "phrase", "start", "text"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.col(text_col).alias("text"), n_words.cast("long").alias("n")).mapInArrow(run, f"doc_id {ids}, {HITS}")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?iu)" + pattern)).cast("long")


def without_contained(found: Column) -> Column:
    """Of findings (array of start, text, weight, kind, rule) those that no earlier one of at least their weight covers.

    In the order of start, longest first; equal (kind, rule, start) count once. One pass in the row.
    """
    order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).when(F.length(a["text"]) != F.length(b["text"]), F.signum(F.length(b["text"]) - F.length(a["text"])).cast("int")).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0)
    end = lambda x: x["start"] + F.length(x["text"])
    ordered = F.array_sort(found, order)
    earlier = lambda i: F.slice(F.col("_ordered"), F.lit(1), i)
    kept = F.filter("_ordered", lambda x, i: ~F.exists(earlier(i), lambda y: (end(y) >= end(x)) & (y["weight"] >= x["weight"])))
    return ordered, kept
