"""Preparation of a text: invisible signs out, look-alike letters repaired, code and protected parts blanked, service
parts of an article found, and every place led back to the source.

All of it works in the row, without a shuffle; rows of one id stay apart. Null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from . import rows as R
from .rows import once
from .rules import placed

# Signs that have no width: zero-width ones, the soft hyphen, marks of direction, the Mongolian vowel
# separator, tags and the selectors of ideographs.
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{200E}\x{200F}\x{061C}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{180E}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]+"
# The same signs for Spark: a letter of a common script is told from them by the first part.
SIGNS = rf"[\x{{AD}}\x{{61C}}\x{{180E}}-\x{{E01EF}}&&{INVISIBLE[:-1]}]+"
# Letters of two scripts side by side; no other word has letters put into it.
MIXED = r"\p{IsCyrillic}(?:[A-Za-z]|(?<=[A-Za-z]\p{IsCyrillic}))"
# Latin letters and the Cyrillic ones that look like them.
LATIN, CYRILLIC = "aeopcxykmthbAEOPCXYKMTHB", "аеорсхукмтнвАЕОРСХУКМТНВ"
# What is no prose: a header between lines of three hyphens, fenced blocks, code in a line.
CODE = r"(?m)(?s:\A---\n.*?\n---(?:\n|\z))|^(?:`{3}[^\n]*\n(?s:.*?)^`{3}[^\n]*$|~{3}[^\n]*\n(?s:.*?)^~{3}[^\n]*$)|`[^`\n]+`"
# Comments, formulas, addresses, link targets, tables, block quotes, quoted words up to 400 characters, citations.
PROTECTED = (
    r"(?m)<!--(?s:.*?)-->|\$\$(?s:.*?)\$\$|\$[^$\n]+\$|\\\((?s:.*?)\\\)|https?://[^\s)>\]»]+|\]\([^)\n]*\)|^[ \t]*[|>].*$"
    r"|«[^«»\n]{0,400}»|„[^„“\n]{0,400}“|\"[^\"\n]{1,400}\"|“[^“”\n]{1,400}”|\\?\[[0-9]+(?:[,;–-]\s*[0-9]+)*(?:,\s*с\.\s*[0-9]+(?:[–-][0-9]+)?)?\\?\]|\[-?@[^\]\n]+\]"
)
# Headings and labels of service parts, and the signs of an entry of a bibliography.
MARK = r"(?:\*\*|__|\*|_)?"
LEAD = rf"(?iu)^[ \t]*(?:#{{1,6}}[ \t]+)?{MARK}[ \t]*(?:[0-9]{{1,2}}\.?[ \t]+)?"
TAIL = rf"[ \t]*[.:]?[ \t]*{MARK}[ \t]*[.:]?[ \t]*$"
BIBLIOGRAPHY = LEAD + (
    r"(?:список[ \t]+(?:использованн\p{L}*[ \t]+)?(?:литературы|источников)(?:[ \t]+и[ \t]+литературы)?|библиографическ\p{L}*[ \t]+список"
    r"|библиография|литература|источники|references|bibliography|literature|works[ \t]+cited)"
) + TAIL
AUTHORS = LEAD + (
    r"(?:(?:сведения|информация)[ \t]+об[ \t]+автор(?:е|ах)|об[ \t]+автор(?:е|ах)|(?:information[ \t]+)?about[ \t]+the[ \t]+authors?|authors?[ \t]+information)"
) + TAIL
KEYWORDS = rf"(?iu)^[ \t]*{MARK}[ \t]*(?:ключевые[ \t]+слова|keywords|key[ \t]+words)[ \t]*{MARK}[ \t]*[:.—–-]"
ABSTRACT = rf"(?iu)^[ \t]*(?:#{{1,6}}[ \t]+)?{MARK}[ \t]*(?:abstract|annotation|summary)[ \t]*{MARK}[ \t]*"
FRONT = (
    rf"(?iu)^[ \t]*{MARK}[ \t]*(?:(?:УДК|ББК|UDC|BBK)(?:[^\p{{L}}0-9]|$)|(?:поступил[аио]?[ \t]+в[ \t]+редакцию|принят[аоы]?[ \t]+(?:к[ \t]+публикации|в[ \t]+печать)"
    r"|received|accepted|revised)[ \t]*[:.]?[ \t]*(?:[0-9]|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\p{L}*\.?[ \t]+[0-9]))"
)
CITE_AS = rf"(?iu)^[ \t]*{MARK}[ \t]*(?:для[ \t]+цитирования|for[ \t]+citation|how[ \t]+to[ \t]+cite|cite[ \t]+as)[ \t]*{MARK}[ \t]*:"
ENTRY_START = r"^[ \t]*(?:(?:[-*+][ \t]+)?(?:\*\*|__)?(?:\\?\[)?[0-9]{1,3}\\?[.)\]](?:\*\*|__)?[ \t]+|\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?,?[ \t]+\p{Lu}\.)"
ENTRY_YEAR = r"(?:^|[^0-9])(?:1[89]|20)[0-9][0-9](?:[^0-9]|$)"
ENTRY_SIGN = (
    r"(?:^|[^:/])//(?:[^/]|$)|[ \t][—–][ \t](?:(?:1[89]|20)[0-9][0-9]|(?:[СсТт№]|[PpNn])\.?[ \t]|URL|DOI|Vol|Iss|(?:М|СПб|Л|Киев|Минск)\.?[ \t]?:|[0-9]{1,4}[ \t]с\.|Текст[ \t]?[:.])"
    r"|№[ \t]*[0-9]|(?:^|\P{L})(?:(?:Vol|Iss|pp|Pp|Bd)\.|(?:DOI|doi|URL|ISBN|ISSN)(?:\P{L}|$)|et[ \t]+al\.|(?:[СсТт]|[Pp])\.[ \t]?[0-9])"
    r"|[ \t]:[ \t]\p{Lu}[^\n:]{1,60},[ \t]*(?:1[89]|20)[0-9][0-9]|Электронный[ \t]+ресурс|[ \t]/[ \t]\p{Lu}\.[ \t]?(?:\p{Lu}\.[ \t]?)?\p{Lu}\p{Ll}"
)
ENTRY_PLACE = r"(?:^|\P{L})(?:М|СПб|Л|Киев|Минск)\.,?[ \t]|https?://"
LABEL = r"\*\*[^*\n]{1,40}:\*\*"
# Characters of an entry and of a line of keywords, words and lines about authors, words and paragraphs of
# an English head, entries that are a bibliography without a heading.
ENTRY_CHARS, KEYWORD_CHARS, AUTHOR_WORDS, AUTHOR_LINES, HEAD_WORDS, HEAD_PARAGRAPHS, ENTRIES = 600, 400, 40, 40, 60, 4, 3
# Blanks of other widths, which count as plain ones.
BLANKS = "\u00a0\u202f\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u205f\u3000"

#: Every line of a text is one letter (see `line_kinds`); service parts are the matches of PARTS in the string of letters.
_ANY = "ECcKkSslLM"
PARTS = {
    "bibliography": f"[Bb][{_ANY}FBb]*[Rr][{_ANY}FBbRr]*",
    "authors": f"[Aa]E*(?:[{_ANY}FR]*[PrdN]){{0,{AUTHOR_LINES}}}[{_ANY}FR]*",
    "front": "F",
    "citation": "C[^E]*",
    "keywords": "K",
    "abstract": f"(?:l+E*){{0,{HEAD_PARAGRAPHS}}}(?:s[^E]*|SE*[lLdD][^E]*)",
    "entries": f"R(?:E*R){{{ENTRIES - 1}}}[RE]*",
}
#: a paragraph of an English head is taken whole or not at all
SERVICE = "|".join(PARTS.values()).replace("l+E*", "l++E*+")


def shifts(text: Column) -> Column:
    """Where signs without width were: array of the place in the text without them and all signs dropped up to it.

    One element for each run of such signs, so it is as long as the findings and not as the text.
    """
    gaps, signs = _sizes(F.split(text, SIGNS, -1)), _sizes(F.regexp_extract_all(text, F.lit(SIGNS), F.lit(0)))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("gone"), F.array().cast("array<struct<at:bigint,gone:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        at, gone = s["at"] + x["gap"], s["gone"] + x["sign"]
        return F.struct(at.alias("at"), gone.alias("gone"), F.concat(s["out"], F.array(F.struct(at.alias("at"), gone.alias("gone")))).alias("out"))

    # the last gap has no sign behind it
    pairs = F.filter(F.zip_with(gaps, signs, lambda gap, sign: F.struct(gap.alias("gap"), sign.alias("sign"))), lambda x: x["sign"].isNotNull())
    return F.when(text.rlike(SIGNS), F.aggregate(pairs, begin, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<at:bigint,gone:bigint>>"))


def _sizes(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def to_source(moved: Column, at: Column) -> Column:
    """The place in the source of the sign that stands at `at` of the prepared text."""
    return at + F.coalesce(F.array_max(F.transform(F.filter(moved, lambda s: s["at"] <= at), lambda s: s["gone"])), F.lit(0).cast("long"))


def spoofed(part: Column) -> Column:
    """The script of letters put into a word of the other one: latin, cyrillic or null.

    The word's own script is the one that has a letter without a double; where both or none do, the commoner one (Cyrillic
    if they tie). A Latin stem with a Russian ending or capitals before a Russian suffix are no trick, nor is a
    sign of multiplication between single letters.
    """
    a, c = f"[{LATIN}]", f"[{CYRILLIC}]"
    n = lambda p: F.regexp_count(part, F.lit(p))
    own_l, own_c = n("[A-Za-z]") > n(a), n(r"\p{IsCyrillic}") > n(c)
    latin = F.when(own_l != own_c, own_c).otherwise(n("[A-Za-z]") <= n(r"\p{IsCyrillic}"))
    in_cyrillic = part.rlike(rf"\p{{IsCyrillic}}{a}+(?:\p{{IsCyrillic}}|[0-9]*$)") | (part.rlike(rf"^{a}+\p{{IsCyrillic}}") & ~part.rlike(r"^[A-Z]{2,}\p{Ll}"))
    in_latin = part.rlike(rf"[A-Za-z]{c}+[A-Za-z]") | part.rlike(rf"^{c}{{1,2}}[a-z]")
    times = part.rlike(r"^(?:[A-Za-z][хХ][A-Za-z]|\p{IsCyrillic}[xX]\p{IsCyrillic})$")
    mixed = part.rlike("[A-Za-z]") & part.rlike(r"\p{IsCyrillic}") & ~times
    return F.when(mixed & latin & in_cyrillic, "latin").when(mixed & ~latin & in_latin, "cyrillic")


def repaired(text: Column) -> Column:
    """The text with look-alike letters in the script of their word; the length stays.

    Only words of lines that have letters of two scripts side by side are looked at."""
    word = r"[\p{L}\p{N}]+"
    # The word goes to the script that has more letters in it, whichever letters were the foreign ones.
    latin = lambda w: F.regexp_count(w, F.lit("[A-Za-z]")) > F.regexp_count(w, F.lit(r"\p{IsCyrillic}"))
    mend = lambda w: F.when(~w.rlike(MIXED) | spoofed(w).isNull(), w).when(latin(w), F.translate(w, CYRILLIC, LATIN)).otherwise(F.translate(w, LATIN, CYRILLIC))
    whole = lambda x: F.array_join(F.zip_with(F.split(x, word, -1), F.regexp_extract_all(x, F.lit(word), F.lit(0)), lambda gap, w: F.concat(gap, F.coalesce(mend(w), F.lit("")))), "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(MIXED), whole(x)).otherwise(x))
    return F.when(text.rlike(MIXED), F.array_join(lines, "\n")).otherwise(text)


def line_kinds(lines: Column, plain: Column, short: Column) -> Column:
    """One letter for each line of a paragraph; `plain`: its letters are mostly Latin, `short`: at most 60 words.

    E empty; B, A heading of a bibliography, of authors (b, a with #); H another heading; F front matter; C citation of
    the article (c where its paragraph is longer than an entry); K keywords (k longer, or with several labels); S, s label
    of an abstract, alone or with its text; R entry of a bibliography; r line that is like one; l, L line of Latin letters
    in a short, a long Latin paragraph, M in another one; d, D another line of such a paragraph; P, p all else, of
    at most 40 words or more; N a line without letters.
    """

    def kind(x: Column, i: Column) -> Column:
        cyrillic, latin = T.letters(x, "Cyrillic"), T.letters(x, "Latin")
        entry = (F.length(x) <= ENTRY_CHARS) & x.rlike(ENTRY_YEAR)
        few = F.size(T.words(x)) <= AUTHOR_WORDS
        lower = x.rlike("^#{1,6}[ \t]")
        rest = F.slice(lines, i + 1, F.size(lines))
        label = F.when(x.rlike(ABSTRACT + "$"), "S").when(x.rlike(ABSTRACT + "[:.—–-]") & plain, "s")
        return (
            F.when(F.trim(F.translate(x, "\t\r", "  ")) == "", "E")
            .when(x.rlike(BIBLIOGRAPHY), F.when(lower, "b").otherwise("B"))
            .when(x.rlike(AUTHORS), F.when(lower, "a").otherwise("A"))
            .when(x.rlike(FRONT), "F")
            .when(x.rlike(CITE_AS), F.when(F.length(F.array_join(rest, "\n")) <= ENTRY_CHARS, "C").otherwise("c"))
            .when(x.rlike(KEYWORDS), F.when((F.length(x) <= KEYWORD_CHARS) & (F.regexp_count(x, F.lit(LABEL)) <= 1), "K").otherwise("k"))
            .when(label.isNotNull(), label)
            .when(lower, "H")
            .when(entry & x.rlike(ENTRY_SIGN), F.when(x.rlike(ENTRY_START), "R").otherwise("r"))
            .when(entry & x.rlike(ENTRY_PLACE), "r")
            .when(latin > cyrillic, F.when(plain & short, "l").when(plain, "L").otherwise("M"))
            .when(plain, F.when(short, "d").otherwise("D"))
            .when(cyrillic + latin == 0, F.when(few, "N").otherwise("p"))
            .otherwise(F.when(few, "P").otherwise("p"))
        )

    return F.array_join(F.transform(lines, kind), "")


def service_parts(docs: DataFrame, text_col: str = "text", name: str = "service") -> DataFrame:
    """docs with service parts of an article: array of kind, first_line, last_line (from 1), start, end.

    Bibliographies (with a heading and an entry, or three entries in a row), keywords, English abstracts with
    the paragraphs above them, parts about authors, lines of classification and dates, the citation of the article. Code
    and a header of the file are none. A heading with # stays outside its part. A heading about the authors without # counts in the
    second half of the lines only. Lines are classified once and parts are one pattern over their letters, so the work grows with
    the lines and not with the parts; a paragraph is judged as a whole where its length or script counts.
    """
    text = F.translate(spans.blanked(F.coalesce(F.col(text_col), F.lit("")), CODE), BLANKS, " " * len(BLANKS))
    rows = once(docs, _t=text)
    # Every block but the first begins with an empty line, which its paragraph follows.
    rows = once(rows, _p=F.split("_t", r"\n(?=[ \t\r]*(?:\n|\z))", -1))
    cyrillic, latin = (lambda p, s=s: T.letters(p, s) for s in ("Cyrillic", "Latin"))
    facts = F.transform("_p", lambda p: F.struct(F.split(p, "\n", -1).alias("lines"), (latin(p) > cyrillic(p)).alias("plain"), (F.size(T.words(p)) <= HEAD_WORDS).alias("short")))
    rows = once(rows, _b=facts)
    rows = once(rows, _k=F.array_join(F.transform("_b", lambda b: line_kinds(b["lines"], b["plain"], b["short"])), ""))
    half = F.floor(F.length("_k") / 2).cast("int")
    rows = once(rows, _l=F.concat(F.translate(F.left("_k", half), "A", "P"), F.substr("_k", half + 1)))
    rows = once(rows, _h=F.when(F.col("_l").rlike(SERVICE), placed(F.col("_l"), SERVICE)).otherwise(F.array().cast("array<struct<start:bigint,line:bigint,col:bigint,text:string>>")))
    until = lambda k: F.length(F.call_function("substring_index", F.col("_t"), F.lit("\n"), k)).cast("long")

    def part(h: Column) -> Column:
        kind = F.lit(None).cast("string")
        for what, letters in (("abstract", "lsS"), ("entries", "R"), ("keywords", "K"), ("citation", "C"), ("front", "F"), ("authors", "Aa"), ("bibliography", "Bb")):
            kind = F.when(F.left(h["text"], F.lit(1)).isin(*letters), what).otherwise(kind)
        first = (h["start"] + F.left(h["text"], F.lit(1)).isin("a", "b").cast("int")).cast("int")
        last = (h["start"] + F.length(F.rtrim(h["text"], F.lit("E"))) - 1).cast("int")
        return F.struct(kind.alias("kind"), (first + 1).cast("long").alias("first_line"), (last + 1).cast("long").alias("last_line"), F.when(first > 0, until(first) + 1).otherwise(0).alias("start"), until(last + 1).alias("end"))

    # A heading about authors without a line below it is no part.
    full = F.filter("_h", lambda h: ~F.left(h["text"], F.lit(1)).isin("A", "a") | (F.length(F.rtrim(h["text"], F.lit("E"))) > 1))
    return rows.select(*docs.columns, F.transform(full, part).alias(name))


def blanked_parts(text: Column, parts: Column) -> Column:
    """The text with the ranges (start, end; sorted, apart) turned into blanks; line breaks and the length stay."""
    gap = lambda x, i: F.substr(text, F.coalesce(F.get(parts, i - 1)["end"], F.lit(0)).cast("int") + 1, (x["start"] - F.coalesce(F.get(parts, i - 1)["end"], F.lit(0))).cast("int"))
    inside = lambda x: F.regexp_replace(F.substr(text, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int")), "[^\n]", " ")
    head = F.array_join(F.transform(parts, lambda x, i: F.concat(gap(x, i), inside(x))), "")
    return F.when(F.size(parts) > 0, F.concat(head, F.substr(text, F.element_at(parts, -1)["end"].cast("int") + 1))).otherwise(text)


def prepared(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `plain`, `prose`, `service` and `moved`.

    plain: the source without signs of no width, with plain hyphens and ye for yo, and look-alike letters in the script
    of their word. prose: plain with code, service parts and protected parts blank, sign for sign as long. A place
    of either leads to the source by to_source(moved, place).
    """
    source = F.coalesce(F.col(text_col), F.lit(""))
    rows = once(docs, moved=shifts(source), _v=T.plain_yo(F.regexp_replace(source, SIGNS, "")))
    rows = service_parts(once(rows, plain=repaired(F.col("_v"))), "plain")
    rows = once(once(rows, _m=spans.blanked(F.col("plain"), CODE)), _c=blanked_parts(F.col("_m"), F.col("service")))
    return rows.select(*docs.columns, "plain", spans.blanked(F.col("_c"), PROTECTED).alias("prose"), "service", "moved")


def plain_matches(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """The other columns of docs beside word, plain_at and source_at: the matches (never empty) of a pattern in the plain
    text of `prepared`, each with its place there and in the source.

    Texts are cut in the row; only the words and the lengths of what is between them go to the workers, where all places
    of a batch are sums and one search, so the work grows with the text, however many matches and signs it has. Nothing
    is shuffled, and service parts and prose aren't made.
    """
    others = [c for c in docs.columns if c != text_col]
    taken = {"word", "plain_at", "source_at"} & {*others}
    if taken:
        raise ValueError(f"columns of these names are made here: {sorted(taken)}")
    rows = once(R.small_batches(docs).select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("_s")), _g=F.split("_s", SIGNS, -1))
    signs = F.when(F.size("_g") > 1, _sizes(F.regexp_extract_all("_s", F.lit(SIGNS), F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = once(rows, _v=T.plain_yo(F.array_join("_g", "")), _signs=signs)
    rows = once(rows.select(*others, _sizes(F.col("_g")).alias("_kept"), "_signs", "_v"), _p=repaired(F.col("_v")))
    rows = rows.select(*others, "_kept", "_signs", _sizes(F.split("_p", pattern, -1)).alias("_gaps"), F.regexp_extract_all("_p", F.lit(pattern), F.lit(0)).alias("_words"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            kept, signs, gaps, words = (b.column(len(others) + k) for k in range(4))
            at, plain, source = _places(kept, signs, gaps, words)
            flat = words.flatten()
            for k in range(0, len(at), R.SLICE):
                some = slice(k, k + R.SLICE)
                columns = [b.column(c).take(pa.array(at[some])) for c in range(len(others))]
                yield pa.record_batch([*columns, flat[some], pa.array(plain[some]), pa.array(source[some])], names=[*others, "word", "plain_at", "source_at"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(others)]]
    return rows.mapInArrow(run, ", ".join([*schema, "word string", "plain_at bigint", "source_at bigint"]))


def _places(kept, signs, gaps, words):
    """Row, place in the plain text and in the source of all words of a batch, as arrays. Lists of each row: lengths of what
    is between signs of no width, those of the signs, lengths of what is between words, and the words."""
    import numpy as np
    import pyarrow.compute as pc

    def cut(before, pieces):
        """How many pieces each row has, each piece's row and the length of what is before it (a row's last gap is before none)."""
        n = np.asarray(pieces.value_lengths(), np.int64)
        return n, np.repeat(np.arange(len(n)), n), np.delete(np.asarray(before.flatten(), np.int64), np.cumsum(n + 1) - 1)

    def within(x, n):
        """Running sums of x, from 0 in each row."""
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[1:] - np.repeat(sums[np.cumsum(n) - n], n)

    n, row, gap = cut(gaps, words)
    size = np.asarray(pc.utf8_length(words.flatten()), np.int64)
    plain = within(gap + size, n) - size
    m, sign_row, gap = cut(kept, signs)
    at = within(gap, m)
    # No text has 2^32 signs, so row and place are one number.
    seen = np.searchsorted((sign_row << 32) + at, (row << 32) + plain, side="right")
    gone = np.concatenate([[0], np.cumsum(np.asarray(signs.flatten(), np.int64))])
    return row, plain, plain + gone[seen] - gone[(np.cumsum(m) - m)[row]]
