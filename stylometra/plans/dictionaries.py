"""Queries of the dictionary engine, fragments' features, intervals and further edit checks, and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..operators import evaluation, fragments, intervals
from ..operators.dictionary import Entry
from ..operators.fragments import BIAS, LIMIT, NAMES, WEIGHTS
from ..operators.rows import once
from ..operators.rules import placed, ranges
from ..sources import tables as S
from .queries import HALF_UP, WORDS
from .rules import _lit
from .structure import MARKED_SQL, _marked

#: phrases of our own, in the languages of the documents and of the passages before them
ENTRIES = [
    Entry("tier1", "самый (важный|полный)", "P1"), Entry("tier1", "очень ярк*", "P1", ("social",)), Entry("tier1-clarity", "решил* продолжить", "P2", (), {"": 1, "academic": 9}),
    Entry("calque", "в (конце)? конц*", "P1"), Entry("jargon", "запуск", "P1", ("technical",)), Entry("template", "кроме того", "P1"), Entry("transition", "однако", "P2"),
    Entry("filler", "просто", "P2", ("chat",)), Entry("claim", "рост виден", "P1"), Entry("chatbot", "вот готовый вариант", "P0"), Entry("chat-wrapper", "вариант текста", "P0"),
    Entry("social", "без обмана", "P2", ("academic",)), Entry("idiolect", "новый взгляд", "P2"), Entry("idiolect", "полный обзор", "P2"), Entry("phrase3", "и ещё", "P2"),
]
EXEMPT = ("кроме того", "решил* продолжить")
MODES = ["general", "academic", "technical", "social", "chat"]
SPANS = (r"\p{L}{7,}", r"[0-9a-f]+ [a-z]+")
TIER2 = ["the", "and", "thing", "und", "les"]
TIER3 = ["tion", "ing", "able"]
TAIL = r"(?:[^\p{L}\p{N}_]|$)"
IDIOMS = ["новый взгляд", "полный обзор", "ясный итог", "быстрый старт"]
CHECKS = {"v_citations": r"\[[0-9]+\]|\[@[^\]]+\]", "v_tables": r"\|[^\n]*\|", "v_quotes": "«[^»\n]*»|„[^“\n]*“", "v_formulas": r"\$[^$\n]+\$"}
NUMERALS = {"один": 1, "два": 2, "три": 3, "пять": 5, "раз": 1}
MONTHS = ["январ", "феврал", "март", "апрел", "ма[йя]", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр"]
CLAIMS, HEDGES = ["важн[а-я]*", "сам[а-я]* полн[а-я]*", "очень"], ["вчера", "также", "кое-что"]
UNITS = ["рублей", "кг", "дней"]
RARE = "[;:()!?…]"


def _n(x):
    return F.size(T.words(x))


def _hits(mode: str):
    def query(spark, sf_dir):
        return D.dictionary_hits(_marked(spark, sf_dir), ENTRIES, mode, F.regexp_count("text", F.lit(T.WORD)), EXEMPT if mode == "academic" else ())

    return query


#: entries by a rule: every two words of the first and the last list, near or far from a word of the other
FIRST, LAST = "the and haus und les der une para pour some sans con mit del est".split(), "able ing tion ung ment ción tes ers ons ais ent ter ver".split()
WIDE = [Entry("pair", f"{a} *{b}", near=(FIRST[(k + 1) % len(FIRST)],) if k % 3 == 0 else (), unless=(FIRST[(k + 2) % len(FIRST)],) if k % 3 == 1 else (), within=4 + k % 3) for k, a in enumerate(FIRST) for b in LAST]


def dictionary_wide(spark, sf_dir):
    """195 phrases with and without words beside them, in one walk over each text."""
    found = D.dictionary_hits(_marked(spark, sf_dir), WIDE, "general", F.regexp_count("text", F.lit(T.WORD)))
    return found.groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def tier2_words(spark, sf_dir):
    """Documents with two or more different words of a list, with the first place of each in the text's words."""
    rows = _marked(spark, sf_dir).select("doc_id", F.transform(T.words(F.col("text")), F.lower).alias("w"))
    found = F.filter(F.array(*(F.struct(F.lit(x).alias("word"), F.array_position("w", x).alias("at")) for x in TIER2)), lambda x: x["at"] > 0)
    return rows.select("doc_id", F.size(found).cast("long").alias("n_words"), F.array_min(F.transform(found, lambda x: x["at"])).cast("long").alias("first")).where("n_words >= 2")


def tier3_density(spark, sf_dir):
    hits = sum((D.count(F.col("text"), x + TAIL) for x in TIER3), F.lit(0))
    rows = _marked(spark, sf_dir).select("doc_id", hits.cast("long").alias("n_hits"), _n(F.col("text")).cast("long").alias("n_words"))
    return rows.where("n_words >= 150 and n_hits * 100 >= n_words * 3")


def phrase3(spark, sf_dir):
    """Phrases of three words that a text has twice or more.

    Texts go to their id once, not each of their phrases. An id of one row has all of its phrases there, so they are
    counted in the row and only repeated ones leave it; all phrases of ids of several rows are counted together.
    """
    # a row without id has no passage and, as in SQL, no text
    rows = _marked(spark, sf_dir).where("doc_id is not null").withColumn("_k", F.count("*").over(Window.partitionBy("doc_id")))
    rows = once(rows, _w=F.transform(T.words(F.col("text")), F.lower)).where("size(_w) >= 3")
    rows = once(rows, _p=F.sort_array(F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.array_join(F.slice("_w", i, 3), " "))))
    # in a row's sorted phrases only the borders of runs are compared
    alone, borders = F.col("_k") == 1, F.filter(F.transform("_p", lambda p, i: F.when((i == 0) | (F.get("_p", i - 1) != p), i)), lambda i: i.isNotNull())
    rows = once(rows, _b=F.when(alone, borders))
    runs = F.zip_with("_b", F.concat(F.slice("_b", F.lit(2), F.size("_b")), F.array(F.size("_p"))), lambda a, z: F.struct(a.alias("a"), (z - a).cast("long").alias("n")))
    repeated = F.transform(F.filter(runs, lambda r: r["n"] >= 2), lambda r: F.struct(F.get("_p", r["a"]).alias("p"), r["n"].alias("n")))
    each = F.when(alone, repeated).otherwise(F.transform("_p", lambda p: F.struct(p.alias("p"), F.lit(1).cast("long").alias("n"))))
    rows = once(rows, _x=each).select("doc_id", F.explode("_x").alias("x")).select("doc_id", "x.p", "x.n")
    return rows.groupBy("doc_id", "p").agg(F.sum("n").alias("n")).where("n >= 2").groupBy("doc_id").agg(F.count("*").alias("n_phrases"), F.max("n").alias("most"))


def idiolect(spark, sf_dir):
    found = F.filter(F.array(*(F.struct(F.lit(x).alias("idiom"), F.position(F.lit(x), F.lower("text")).alias("at")) for x in IDIOMS)), lambda x: x["at"] > 0)
    rows = _marked(spark, sf_dir).select("doc_id", found.alias("f")).where("size(f) >= 2")
    return rows.select("doc_id", F.explode("f").alias("x")).select("doc_id", "x.idiom", (F.col("x.at") - 1).cast("long").alias("start"))


def issues_deduped(spark, sf_dir):
    """Findings without those that another, earlier or longer one of at least their weight covers."""
    text = F.col("text")
    kinds = (("a", "чуж[а-я]+ слова|слова", 2), ("b", r"[а-яё]+ [а-яё]+", 1), ("c", r"[а-яё]{5,}", 2))
    one = lambda name, p, w: F.transform(placed(text, p), lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text"), F.lit(w).alias("weight"), F.lit(name).alias("kind"), F.lit(name).alias("rule")))
    rows = _marked(spark, sf_dir).select("doc_id", F.concat(*(one(*k) for k in kinds)).alias("f"))
    ordered, kept = D.without_contained(F.col("f"))
    return rows.select("doc_id", ordered.alias("_ordered")).select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.kind", "x.start", "x.text")


def _paragraphs(spark, sf_dir) -> DataFrame:
    """The texts with a paragraph for every sentence, as they have few of their own."""
    return _marked(spark, sf_dir).withColumn("text", F.regexp_replace("text", "([.!?]) ", "$1\n\n"))


def _fragments(spark, sf_dir) -> DataFrame:
    """The fragments of all texts, with their measures."""
    text = F.col("text")
    return fragments.measured(fragments.fragments(_paragraphs(spark, sf_dir)), RARE, D.count(text, "важно|кроме того|однако"), D.count(text, "повышение|реализации|деятельности"))


def _features(spark, sf_dir) -> DataFrame:
    return fragments.features(_fragments(spark, sf_dir), "doc_id", "fragment")


def _probability():
    return T.rounded(T.sigmoid(F.lit(BIAS) + sum((w * F.col(x) for w, x in zip(WEIGHTS, NAMES)), F.lit(0.0))), 6)


def fragment_spans(spark, sf_dir):
    """Where the fragments of every text are."""
    return fragments.fragments(_paragraphs(spark, sf_dir)).select("doc_id", F.col("fragment").cast("long").alias("fragment"), "start", "end", "line", "end_line", "n_words", F.length("text").cast("long").alias("n_chars"))


def fragment_measures(spark, sf_dir):
    return _fragments(spark, sf_dir).select("doc_id", "fragment", F.size("w").cast("long").alias("n_words"), F.col("n").cast("long").alias("n_sentences"), "rare", "signals", "clerical", "mattr")


def fragment_features(spark, sf_dir):
    return _features(spark, sf_dir).drop("n_chars")


def fragment_zone(spark, sf_dir):
    p = F.col("p")
    return _features(spark, sf_dir).select("doc_id", "fragment", _probability().alias("p")).select("doc_id", "fragment", p.alias("probability"), F.when(p >= LIMIT, "red").when(p >= LIMIT - 0.1, "yellow").otherwise("green").alias("zone"))


def fragment_reasons(spark, sf_dir):
    """The three largest contributions above a half, largest first."""
    each = F.array(*(F.struct((-T.rounded(w * F.col(x), 6)).alias("c"), F.lit(x).alias("name")) for w, x in zip(WEIGHTS, NAMES)))
    top = F.slice(F.array_sort(F.filter(each, lambda x: x["c"] < -0.5)), 1, 3)
    return _features(spark, sf_dir).select("doc_id", "fragment", F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("reasons"))


def fragment_explained(spark, sf_dir):
    """Contributions, single goals and the joint plan of every fragment that isn't green."""
    rows = fragments.explained(_features(spark, sf_dir), "doc_id", "fragment").where("excess > 0")
    return rows.select("doc_id", "fragment", "logit", "excess", "reachable", F.explode("steps").alias("s")).select("doc_id", "fragment", "logit", "excess", "reachable", "s.*")


def ai_share(spark, sf_dir):
    rows = _features(spark, sf_dir).select("doc_id", "n_chars", _probability().alias("p"))
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "source")
    per = rows.join(docs, "doc_id").groupBy("source").agg(F.sum(F.when(F.col("p") >= LIMIT, F.col("n_chars")).otherwise(0)).alias("a"), F.sum("n_chars").alias("b"))
    return per.select("source", evaluation.share(100 * F.col("a"), F.col("b"), 4).alias("share"))


def typical_prose(spark, sf_dir):
    """What the model says of typical prose: the probability of the mean features of each language's fragments. Means are
    of whole millionths, so they don't depend on the order of rows."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    each = _features(spark, sf_dir).join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(F.round(F.col(x) * 1_000_000).cast("long")).alias(x) for x in NAMES))
    mean = each.select("lang", "n", *(T.rounded(F.col(x) / F.col("n") / 1_000_000, 6).alias(x) for x in NAMES))
    return mean.select("lang", "n", _probability().alias("probability"))


def interval_union(spark, sf_dir):
    """Characters that the union of overlapping spans covers, and in how many maximal runs; merged in the row."""
    text = F.col("text")
    ends = lambda p: ranges(text, p)
    rows = _marked(spark, sf_dir).select("doc_id", F.array_sort(F.concat(ends(r"\p{L}+ \p{L}+"), ends("[а-яё]{4,}"), ends("[0-9]+"))).alias("s"))
    begin = F.struct(*(F.lit(0).cast("long").alias(x) for x in ("covered", "runs", "end")))
    step = lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0), x["z"] - F.greatest(x["a"], s["end"]))).alias("covered"), (s["runs"] + F.when((s["runs"] == 0) | (x["a"] > s["end"]), 1).otherwise(0)).cast("long").alias("runs"), F.greatest(s["end"], x["z"]).alias("end"))
    out = rows.select("doc_id", F.aggregate("s", begin, step).alias("u"))
    return out.select("doc_id", "u.covered", "u.runs")


def _span_sets(spark, sf_dir) -> DataFrame:
    """Two sets of spans of each text: words of seven letters and more, and every run of two words."""
    ends = lambda p: ranges(F.col("text"), p)
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", ends(SPANS[0]).alias("p"), ends(SPANS[1]).alias("t"))


def span_metrics(spark, sf_dir):
    """Precision and recall by characters of one set of spans against the other, by language."""
    return intervals.span_metrics(_span_sets(spark, sf_dir), "p", "t", "lang")


def interval_algebra(spark, sf_dir):
    """How much of each text's two sets of spans is shared, and how much only one has."""
    return intervals.measured(_span_sets(spark, sf_dir), "p", "t").select("doc_id", "union", "both", "only_left", "only_right")


def boundary_bins(spark, sf_dir):
    """Fragments of 200 characters by the share of them that marked lines (every second one) cover."""
    sign = lambda x, i: F.regexp_replace(x, "(?s).", F.when(i % 2 == 1, "x").otherwise("."))
    marks = F.array_join(F.transform(F.split("text", "\n"), sign), ".")
    each = S.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(marks, F.lit(".{1,200}"), F.lit(0))).alias("p"))
    share = each.select((F.length(F.replace("p", F.lit("."))) * 100).alias("x"), F.length("p").cast("long").alias("w"))
    name = F.when(F.col("x") <= 5 * F.col("w"), "human").when(F.col("x") >= 95 * F.col("w"), "marked").otherwise(F.concat(F.lit("part"), F.least(F.floor(F.col("x") / F.col("w") / 25), F.lit(3)).cast("string")))
    return share.groupBy(name.alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("n_chars"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Before and after an edit that changes numbers, adds words and drops some, by doc_id."""
    k, text = F.pmod("doc_id", F.lit(5)), F.col("text")
    after = F.when(k == 0, F.replace(text, F.lit("два"), F.lit("пять"))).when(k == 1, F.concat(text, F.lit(" очень важный март"))).when(k == 2, F.replace(text, F.lit("рублей"), F.lit("кг"))).when(k == 3, F.replace(F.replace(text, F.lit("вчера"), F.lit("")), F.lit("«"), F.lit("“"))).otherwise(F.replace(F.replace(F.replace(text, F.lit("[1]"), F.lit("[2]")), F.lit("| 1 |"), F.lit("| 3 |")), F.lit("$a"), F.lit("$c")))
    return _marked(spark, sf_dir).select("doc_id", F.col("text").alias("before"), after.alias("after"))


def _has(column: str, pattern: str):
    return F.col(column).rlike("(?iu)" + pattern)


def v_numerals(spark, sf_dir):
    """Number words that only the edited text has and whose value its source doesn't hold in digits."""
    rows = _pairs(spark, sf_dir)
    new = F.array(*(F.when(_has("after", D.NOT_WORD + w) & ~_has("before", D.NOT_WORD + w) & ~F.col("before").rlike(rf"(?:^|[^0-9]){v}(?:[^0-9]|$)"), w) for w, v in NUMERALS.items()))
    return rows.select("doc_id", F.explode(F.filter(new, lambda x: x.isNotNull())).alias("numeral"))


def v_months(spark, sf_dir):
    new = F.array(*(F.when(_has("after", D.NOT_WORD + m) & ~_has("before", D.NOT_WORD + m), m) for m in MONTHS))
    return _pairs(spark, sf_dir).select("doc_id", F.explode(F.filter(new, lambda x: x.isNotNull())).alias("month"))


def _growth(words: list[str], grown: bool):
    def query(spark, sf_dir):
        counts = F.array(*(F.struct(F.lit(w).alias("key"), D.count(F.col("before"), w).alias("n_before"), D.count(F.col("after"), w).alias("n_after")) for w in words))
        rows = _pairs(spark, sf_dir).select("doc_id", F.explode(counts).alias("c")).select("doc_id", "c.*")
        return rows.where("n_after > n_before" if grown else "n_after < n_before")

    return query


def v_units(spark, sf_dir):
    """Numbers whose unit an edit changed: the same number, no unit in common."""
    pattern = f"([0-9]+) ({'|'.join(UNITS)})"
    each = lambda c: _pairs(spark, sf_dir).select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("u"))).alias("x")).groupBy("doc_id", F.col("x.n").alias("number")).agg(F.array_sort(F.collect_set("x.u")).alias(c))
    both = each("before").join(each("after"), ["doc_id", "number"]).where(~F.arrays_overlap("before", "after"))
    return both.select("doc_id", "number", F.array_join("before", ",").alias("was"), F.array_join("after", ",").alias("now"))


QUERIES = {f.__name__: f for f in (dictionary_wide, span_metrics, interval_algebra, tier2_words, tier3_density, phrase3, idiolect, issues_deduped, fragment_spans, fragment_explained, fragment_measures, fragment_features, fragment_zone, fragment_reasons, ai_share, typical_prose, interval_union, boundary_bins, v_numerals, v_months, v_units)}
QUERIES |= {"v_claims": _growth(CLAIMS, True), "v_hedges": _growth(HEDGES, False)} | {f"dictionary_{m}": _hits(m) for m in MODES}

_LOW = f"list_transform({WORDS}, lambda x: lower(x))"
_SENT = rf"list_filter(string_split(regexp_replace(text, '([.!?…]+)\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: len({WORDS.replace('text,', 's,')}) > 0)"
_COUNT = lambda p, x="text": f"CAST(len(regexp_extract_all({x}, {_lit('(?i)' + p)})) AS BIGINT)"


def _places(source: str, pattern: str, columns: str, flags: str = "") -> str:
    """doc_id, start, hit of a pattern's matches in text."""
    cut = f"SELECT doc_id, string_split_regex(text, {_lit(flags + pattern)}) AS g, regexp_extract_all(text, {_lit(flags + pattern)}) AS h FROM ({source})"
    return f"SELECT doc_id, {columns}, h[i] AS hit, CAST(length(array_to_string(g[1:i], '')) + length(array_to_string(h[1:i - 1], '')) AS BIGINT) AS start FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS i FROM ({cut}))"


def _hits_sql(mode: str) -> str:
    exempt, parts = mode == "academic", []
    for e in (e for e in ENTRIES if D.applies(e, mode)):
        raw = _places(MARKED_SQL, D.NOT_WORD + e.pattern + r"(?:[^\p{L}\p{N}_]|$)", f"{_lit(e.group)} AS grp, {_lit(e.text)} AS phrase", "(?i)")
        least = e.density.get(mode, e.density.get("", 0))
        one = rf"SELECT doc_id, grp, phrase, start + CASE WHEN regexp_matches(hit, '^[\p{{L}}\p{{N}}_]') THEN 0 ELSE 1 END AS start, regexp_replace(regexp_replace(hit, '^[^\p{{L}}\p{{N}}_]', ''), '[^\p{{L}}\p{{N}}_]$', '') AS text FROM ({raw})"
        if exempt:
            one = f"SELECT * FROM ({one}) o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = o.doc_id AND x.start < o.start + length(o.text) AND o.start < x.start + length(x.hit))"
        if least:
            one = f"SELECT o.* FROM ({one}) o JOIN n USING (doc_id) QUALIFY count(*) OVER (PARTITION BY doc_id) * 1000 >= n_words * {least}"
        parts.append(one)
    ranges = f", x AS ({_places(MARKED_SQL, "|".join(map(D.phrase, EXEMPT)), '1 AS k', '(?i)')})" if exempt else ""
    return f"WITH n AS (SELECT doc_id, len({WORDS}) AS n_words FROM ({MARKED_SQL})){ranges} " + " UNION ALL ".join(f"({p})" for p in parts)


_HALF = fragments.LEAST_WORDS // 2
_WORDS_OF = lambda x: f"len({WORDS.replace('text,', x + ',')})"
_PARAGRAPHS = f"SELECT doc_id, regexp_replace(text, '([.!?]) ', '\\1' || chr(10) || chr(10), 'g') AS text FROM ({MARKED_SQL})"
#: blocks of every text in order, then a fold over them: the number of the fragment and the words it has so far
_PACKED = rf"""b AS (
  SELECT doc_id, t, i, s[i] AS block, CAST(length(array_to_string(s[1:i - 1], '')) + length(array_to_string(g[1:i - 1], '')) AS BIGINT) AS start, CASE {' '.join(f"WHEN regexp_matches(s[i], {_lit(p)}) THEN {_lit(k)}" for k, p in fragments.KINDS.items())} ELSE 'prose' END AS kind
  FROM (SELECT doc_id, t, s, g, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, text AS t, string_split_regex(text, {_lit(fragments.BLOCK)}) AS s, regexp_extract_all(text, {_lit(fragments.BLOCK)}) AS g FROM ({_PARAGRAPHS})))
), k AS MATERIALIZED (SELECT *, {_WORDS_OF('block')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM b WHERE regexp_matches(block, '\S')),
fold AS (
  SELECT doc_id, 0 AS r, 0 AS part, 0 AS held, false AS full, 0 AS following FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL
  SELECT doc_id, k.r, f.following, CASE WHEN kind IN ('prose', 'list') THEN held + w ELSE held END * CASE WHEN closes THEN 0 ELSE 1 END, closes, CASE WHEN closes THEN f.following + 1 ELSE f.following END
  FROM (SELECT k.*, f.held, f.following, (kind IN ('prose', 'list') AND held + w >= {fragments.LEAST_WORDS}) OR (kind = 'heading' AND held >= {_HALF} AND held > 0) AS closes FROM fold f JOIN k ON k.doc_id = f.doc_id AND k.r = f.r + 1) k JOIN (SELECT 0) ON true, LATERAL (SELECT k.following) f(following)
), q AS (SELECT k.*, f.part, max(f.part) OVER (PARTITION BY k.doc_id) AS last, sum(k.w) OVER (PARTITION BY k.doc_id, f.part) AS total FROM k JOIN fold f USING (doc_id, r) WHERE kind IN ('prose', 'list')),
fragments AS (
  SELECT doc_id, CAST(part AS BIGINT) AS fragment, min(start) AS start, max(start + length(block)) AS z, CAST(sum(w) AS BIGINT) AS n_words, string_agg(block, chr(10) || chr(10) ORDER BY i) AS text, any_value(t) AS t
  FROM (SELECT doc_id, t, i, block, start, w, CASE WHEN part = last AND total < {_HALF} AND last > 0 THEN part - 1 ELSE part END AS part FROM q) GROUP BY doc_id, part
)"""
_FRAGMENTS = f"(WITH RECURSIVE {_PACKED} SELECT doc_id, fragment, text FROM fragments)"
_FRAGMENT = f"""SELECT doc_id, fragment, {_LOW} AS w, list_filter(list_transform({_SENT}, lambda s: len({WORDS.replace('text,', 's,')})), lambda n: n >= 2) AS z, list_transform({_SENT}, lambda s: lower({WORDS.replace('text,', 's,')}[1])) AS o,
  CAST(len(regexp_extract_all(text, {_lit(RARE)})) AS BIGINT) AS rare, {_COUNT('важно|кроме того|однако')} AS signals, {_COUNT('повышение|реализации|деятельности')} AS clerical, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM {_FRAGMENTS}"""
_MEASURED = f"""WITH f AS MATERIALIZED ({_FRAGMENT}), u AS (SELECT doc_id, fragment, {HALF_UP("sum(u) / (50 * any_value(m))", 6)} AS mattr FROM (SELECT doc_id, fragment, len(w) - 49 AS m, len(list_distinct(w[k : k + 49])) AS u FROM (SELECT doc_id, fragment, w, unnest(range(1, len(w) - 48)) AS k FROM f)) GROUP BY doc_id, fragment)
  SELECT f.*, mattr, len(z) AS n, coalesce(list_sum(z), 0) AS t, coalesce(list_sum(list_transform(z, lambda x: x * x)), 0) AS q, greatest(len(w), 1) AS m FROM f LEFT JOIN u USING (doc_id, fragment)"""
_SQL_FEATURES = (
    "least(4.0, signals * 2 * 100 / m / 3)", "CASE WHEN n >= 3 THEN greatest(0.0, 1 - sqrt(greatest(0.0, (q - t * t / n) / (n - 1))) / (t / n) / 0.6) ELSE 0.3 END", "CASE WHEN n > 0 THEN exp(-pow((t / n - 19) / 7, 2)) ELSE 0.0 END", "least(3.0, clerical * 100 / m / 2)",
    "CASE WHEN n >= 3 THEN greatest(0.0, 1 - rare / n / 0.5) ELSE 0.3 END", "CASE WHEN len(o) >= 3 THEN 1 - len(list_distinct(o)) / len(o) ELSE 0.0 END", "greatest(0.0, least(1.0, (CAST(0.85 AS DOUBLE) - coalesce(mattr, CAST(0.8 AS DOUBLE))) / 0.2))",
)
_FEATURED = f"SELECT doc_id, fragment, n_chars, {', '.join(f'{HALF_UP(v, 6)} AS {x}' for v, x in zip(_SQL_FEATURES, NAMES))} FROM ({_MEASURED})"
_Z = f"(CAST({BIAS} AS DOUBLE) + " + " + ".join(f"CAST({w} AS DOUBLE) * {x}" for w, x in zip(WEIGHTS, NAMES)) + ")"
_P = f"SELECT doc_id, fragment, n_chars, {HALF_UP('1 / (1 + exp(-z))', 6)} AS p FROM (SELECT doc_id, fragment, n_chars, {_Z} AS z FROM ({_FEATURED}))"
_GREEN = math.log((LIMIT - fragments.GREEN_MARGIN) / (1 - LIMIT + fragments.GREEN_MARGIN))
_GIVE = "greatest(0.0, (p.value - p.floor) * p.weight)"
_EXPLAINED = f"""WITH f AS MATERIALIZED ({_FEATURED}), l AS (SELECT *, {HALF_UP(f"logit - (CAST({_GREEN!r} AS DOUBLE))", 6)} AS excess FROM (SELECT *, {HALF_UP(_Z, 6)} AS logit FROM f)),
  p AS (SELECT doc_id, fragment, logit, excess, unnest([{', '.join(f"{chr(123)}feature: {_lit(x)}, value: {x}, weight: CAST({w} AS DOUBLE), floor: CAST({fragments.FLOORS.get(x, 0.0)} AS DOUBLE){chr(125)}" for w, x in zip(WEIGHTS, NAMES))}]) AS p FROM l WHERE excess > 0),
  s AS (SELECT *, {_GIVE} AS give FROM p WHERE p.value > 0),
  t AS (SELECT *, coalesce(sum(give) FILTER (give >= {fragments.LEAST_STEP}) OVER w, 0) AS large, sum(give) OVER w AS whole FROM s WINDOW w AS (PARTITION BY doc_id, fragment)),
  u AS (SELECT *, CASE WHEN large < excess THEN 0 ELSE {fragments.LEAST_STEP} END AS least, CASE WHEN large < excess THEN whole ELSE large END AS given, p.value - excess / p.weight AS goal FROM t)
  SELECT doc_id, fragment, logit, excess, excess <= given AS reachable, p.feature AS feature, p.value AS value, {HALF_UP("p.weight * p.value", 6)} AS contribution, {HALF_UP("CASE WHEN goal > p.floor THEN least(goal, p.value) ELSE p.floor END", 3)} AS goal, goal > p.floor AS enough,
    CASE WHEN given > 0 AND give > 0 AND give >= u.least THEN {HALF_UP("p.value - least(1.0, excess / given) * (p.value - p.floor)", 3)} END AS plan FROM u"""
_AFTER = "CASE doc_id % 5 WHEN 0 THEN replace(text, 'два', 'пять') WHEN 1 THEN text || ' очень важный март' WHEN 2 THEN replace(text, 'рублей', 'кг') WHEN 3 THEN replace(replace(text, 'вчера', ''), '«', '“') ELSE replace(replace(replace(text, '[1]', '[2]'), '| 1 |', '| 3 |'), '$a', '$c') END"
_PAIRS = f"SELECT doc_id, text AS before, {_AFTER} AS after FROM ({MARKED_SQL})"
_MATCH = lambda x, p: f"regexp_matches({x}, {_lit('(?i)' + D.NOT_WORD + p)})"
_UNIT = f"([0-9]+) ({'|'.join(UNITS)})"
_KINDS = (("a", "чуж[а-я]+ слова|слова", 2), ("b", r"[а-яё]+ [а-яё]+", 1), ("c", r"[а-яё]{5,}", 2))
_ALL = " UNION ALL ".join(_places(MARKED_SQL, p, f"'{k}' AS kind, {w} AS weight") for k, p, w in _KINDS)
_UNION = " UNION ALL ".join(_places(MARKED_SQL, p, "1 AS k") for p in (r"\p{L}+ \p{L}+", "[а-яё]{4,}", "[0-9]+"))


def _growth_sql(words: list[str], sign: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, {_lit(w)} AS key, {_COUNT(w, 'before')} AS n_before, {_COUNT(w, 'after')} AS n_after FROM ({_PAIRS})) WHERE n_after {sign} n_before" for w in words)


def _unit_sql(x: str) -> str:
    return f"SELECT doc_id, number, list_sort(list_distinct(list(u))) AS {x} FROM (SELECT doc_id, unnest(regexp_extract_all({x}, {_lit(_UNIT)}, 1)) AS number, unnest(regexp_extract_all({x}, {_lit(_UNIT)}, 2)) AS u FROM ({_PAIRS})) GROUP BY doc_id, number"


#: words with their places; a hit is two words with blanks between, and the words beside it are counted in a window of its own
_WIDE = f"""WITH e(phrase, a, b, near, unless, within) AS (VALUES {', '.join(f"({_lit(e.text)}, {_lit(e.text.split()[0])}, {_lit(e.text.split('*')[1])}, {_lit(e.near[0]) if e.near else 'NULL'}, {_lit(e.unless[0]) if e.unless else 'NULL'}, {e.within})" for e in WIDE)}),
w AS MATERIALIZED (SELECT doc_id, i, lower(x[i]) AS w, regexp_full_match(x[i], '\\p{{L}}+') AS letters, regexp_full_match(g[i + 1], '[ \\t\\n ]+') AS blank FROM (SELECT doc_id, x, g, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS x, string_split_regex(text, '[\\p{{L}}\\p{{N}}_]+') AS g FROM ({MARKED_SQL})))),
h AS (SELECT w.doc_id, w.i, e.* FROM w JOIN w v ON v.doc_id = w.doc_id AND v.i = w.i + 1 AND w.blank JOIN e ON e.a = w.w AND ends_with(v.w, e.b) AND v.letters),
beside AS (SELECT h.doc_id, h.i, h.phrase, bool_or(x.w = h.near) AS has_near, bool_or(x.w = h.unless) AS has_unless FROM h LEFT JOIN w x ON x.doc_id = h.doc_id AND x.i BETWEEN h.i - h.within AND h.i + 1 + h.within AND x.i NOT IN (h.i, h.i + 1) GROUP BY ALL)
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM h JOIN beside USING (doc_id, i, phrase) WHERE (near IS NULL OR has_near) AND (unless IS NULL OR NOT coalesce(has_unless, false)) GROUP BY phrase"""
#: events of both sets, then depths between one event and the next
_SWEPT = f"""WITH e AS (SELECT doc_id, pos, l, r FROM (SELECT doc_id, unnest([start, start + length(hit)]) AS pos, unnest([1, -1]) AS l, 0 AS r FROM ({_places('SELECT doc_id, text FROM documents', SPANS[0], '1 AS k')})
  UNION ALL SELECT doc_id, unnest([start, start + length(hit)]), 0, unnest([1, -1]) FROM ({_places('SELECT doc_id, text FROM documents', SPANS[1], '1 AS k')}))),
s AS (SELECT doc_id, lead(pos) OVER f - pos AS n, sum(l) OVER w > 0 AS l, sum(r) OVER w > 0 AS r FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos, l, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY doc_id ORDER BY pos, l, r)),
m AS (SELECT doc_id, lang, CAST(coalesce(sum(n) FILTER (l AND r), 0) AS BIGINT) AS b, CAST(coalesce(sum(n) FILTER (l AND NOT r), 0) AS BIGINT) AS x, CAST(coalesce(sum(n) FILTER (r AND NOT l), 0) AS BIGINT) AS y FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id, lang)"""
_PR = "CASE WHEN b + x > 0 THEN b / (b + x) WHEN b + y = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN b + y > 0 THEN b / (b + y) WHEN b + x = 0 THEN 1.0 ELSE 0.0 END AS r"
ORACLE_SQL = {
    "interval_algebra": f"{_SWEPT} SELECT doc_id, b + x + y AS \"union\", b AS \"both\", x AS only_left, y AS only_right FROM m",
    "span_metrics": f"{_SWEPT} SELECT lang, count(*) AS n, {HALF_UP('sum(b) / sum(b + x)', 6)} AS micro_precision, {HALF_UP('sum(b) / sum(b + y)', 6)} AS micro_recall, {HALF_UP('2 * sum(b) / sum(2 * b + x + y)', 6)} AS micro_f1, {HALF_UP('avg(p)', 6)} AS macro_precision, {HALF_UP('avg(r)', 6)} AS macro_recall, {HALF_UP('avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END)', 6)} AS macro_f1 FROM (SELECT *, {_PR} FROM m) GROUP BY lang",
    "dictionary_wide": _WIDE,
    "tier2_words": f"SELECT doc_id, CAST(len(f) AS BIGINT) AS n_words, CAST(list_min(f) AS BIGINT) AS first FROM (SELECT doc_id, list_filter(list_transform([{', '.join(map(_lit, TIER2))}], lambda x: list_position(w, x)), lambda p: p > 0) AS f FROM (SELECT doc_id, {_LOW} AS w FROM ({MARKED_SQL}))) WHERE len(f) >= 2",
    "tier3_density": f"SELECT * FROM (SELECT doc_id, {' + '.join(_COUNT(x + TAIL) for x in TIER3)} AS n_hits, CAST(len({WORDS}) AS BIGINT) AS n_words FROM ({MARKED_SQL})) WHERE n_words >= 150 AND n_hits * 100 >= n_words * 3",
    "phrase3": f"SELECT doc_id, count(*) AS n_phrases, max(n) AS most FROM (SELECT doc_id, p, count(*) AS n FROM (SELECT doc_id, array_to_string(w[k : k + 2], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM (SELECT doc_id, {_LOW} AS w FROM ({MARKED_SQL})))) GROUP BY doc_id, p HAVING count(*) >= 2) GROUP BY doc_id",
    "idiolect": f"WITH f AS (SELECT doc_id, i AS idiom, CAST(strpos(lower(text), i) - 1 AS BIGINT) AS start FROM ({MARKED_SQL}), unnest([{', '.join(map(_lit, IDIOMS))}]) AS t(i)) SELECT doc_id, idiom, start FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM f WHERE start >= 0) WHERE c >= 2",
    "issues_deduped": f"WITH f AS ({_ALL}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(hit) DESC, kind) AS k FROM f) SELECT doc_id, kind, start, hit AS text FROM o WHERE NOT EXISTS (SELECT 1 FROM o e WHERE e.doc_id = o.doc_id AND e.k < o.k AND e.start + length(e.hit) >= o.start + length(o.hit) AND e.weight >= o.weight)",
    "fragment_measures": f"SELECT doc_id, fragment, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_sentences, rare, signals, clerical, mattr FROM ({_MEASURED})",
    "fragment_features": f"SELECT doc_id, fragment, {', '.join(NAMES)} FROM ({_FEATURED})",
    "fragment_zone": f"SELECT doc_id, fragment, p AS probability, CASE WHEN p >= 0.5 THEN 'red' WHEN p >= 0.4 THEN 'yellow' ELSE 'green' END AS zone FROM ({_P})",
    "fragment_reasons": f"SELECT doc_id, fragment, array_to_string(list_transform(list_sort(list_filter([{', '.join(chr(123) + f'c: -{HALF_UP(f'CAST({w} AS DOUBLE) * {x}', 6)}, name: {_lit(x)}' + chr(125) for w, x in zip(WEIGHTS, NAMES))}], lambda y: y.c < -0.5))[1:3], lambda y: y.name), ',') AS reasons FROM ({_FEATURED})",
    "ai_share": f"SELECT source, CASE WHEN sum(n) <> 0 THEN {HALF_UP('100 * sum(CASE WHEN p >= 0.5 THEN n ELSE 0 END) / sum(n)', 4)} END AS share FROM (SELECT source, p, f.n_chars AS n FROM ({_P}) f JOIN documents USING (doc_id)) GROUP BY source",
    "fragment_spans": f"WITH RECURSIVE {_PACKED} SELECT doc_id, fragment, start, z AS \"end\", CAST(length(regexp_replace(left(t, start), '[^\n]', '', 'g')) + 1 AS BIGINT) AS line, CAST(length(regexp_replace(left(t, z), '[^\n]', '', 'g')) + 1 AS BIGINT) AS end_line, n_words, CAST(length(text) AS BIGINT) AS n_chars FROM fragments",
    "fragment_explained": _EXPLAINED,
    "typical_prose": f"""SELECT lang, n, {HALF_UP('1 / (1 + exp(-z))', 6)} AS probability FROM (SELECT lang, n, {_Z} AS z FROM (
      SELECT lang, count(*) AS n, {', '.join(f"{HALF_UP(f'CAST(sum(CAST(round({x} * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000', 6)} AS {x}" for x in NAMES)} FROM ({_FEATURED}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang))""",
    "interval_union": f"""WITH s AS (SELECT doc_id, start AS a, start + length(hit) AS z FROM ({_UNION})), m AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s)
      SELECT doc_id, CAST(coalesce(covered, 0) AS BIGINT) AS covered, coalesce(runs, 0) AS runs FROM documents LEFT JOIN (SELECT doc_id, sum(greatest(0, z - greatest(a, coalesce(e, 0)))) AS covered, count(*) FILTER (e IS NULL OR a > e) AS runs FROM m GROUP BY doc_id) USING (doc_id)""",
    "boundary_bins": """WITH l AS (SELECT doc_id, i, length(s[i]) AS n, sum(length(s[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s[i]) - 1 AS a FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
      v AS (SELECT doc_id, b, least(b + 200, c) AS e FROM (SELECT doc_id, length(text) AS c, unnest(range(0, length(text), 200)) AS b FROM documents WHERE length(text) > 0)),
      o AS (SELECT v.doc_id, v.b, v.e - v.b AS w, coalesce(sum(least(l.a + l.n, v.e) - greatest(l.a, v.b)) FILTER (l.a IS NOT NULL), 0) * 100 AS x FROM v LEFT JOIN l ON l.doc_id = v.doc_id AND l.i % 2 = 0 AND l.a < v.e AND l.a + l.n > v.b GROUP BY v.doc_id, v.b, v.e)
      SELECT CASE WHEN x <= 5 * w THEN 'human' WHEN x >= 95 * w THEN 'marked' ELSE 'part' || CAST(least(floor(x / w / 25), 3) AS INTEGER) END AS bin, count(*) AS n, CAST(sum(w) AS BIGINT) AS n_chars FROM o GROUP BY 1""",
    "v_numerals": " UNION ALL ".join(f"SELECT doc_id, {_lit(w)} AS numeral FROM ({_PAIRS}) WHERE {_MATCH('after', w)} AND NOT {_MATCH('before', w)} AND NOT regexp_matches(before, '(?:^|[^0-9]){v}(?:[^0-9]|$)')" for w, v in NUMERALS.items()),
    "v_months": " UNION ALL ".join(f"SELECT doc_id, {_lit(m)} AS month FROM ({_PAIRS}) WHERE {_MATCH('after', m)} AND NOT {_MATCH('before', m)}" for m in MONTHS),
    "v_units": f"SELECT doc_id, number, array_to_string(before, ',') AS was, array_to_string(after, ',') AS now FROM ({_unit_sql('before')}) JOIN ({_unit_sql('after')}) USING (doc_id, number) WHERE len(list_intersect(before, after)) = 0",
    "v_claims": _growth_sql(CLAIMS, ">"), "v_hedges": _growth_sql(HEDGES, "<"),
} | {f"dictionary_{m}": _hits_sql(m) for m in MODES}


def _check(pattern: str):
    def query(spark, sf_dir):
        pairs = _pairs(spark, sf_dir)
        each = lambda c: pairs.select("doc_id", F.explode(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).alias("part"))
        return evaluation.bag_difference(each("before"), each("after"), ["doc_id", "part"])

    side = lambda a, b, label: f"SELECT doc_id, part, '{label}' AS side, count(*) AS surplus FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) GROUP BY ALL"
    each = lambda c: f"SELECT doc_id, unnest(regexp_extract_all({c}, {_lit(pattern)})) AS part FROM ({_PAIRS})"
    return query, f"WITH b AS ({each('before')}), a AS ({each('after')}) {side('b', 'a', 'missing')} UNION ALL {side('a', 'b', 'added')}"


for _name, _pattern in CHECKS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _check(_pattern)
