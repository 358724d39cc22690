"""Queries of structural and typographic detectors, masks and segments on texts with passages of our own before them, and
their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..operators import rules, style
from ..operators.rows import once
from ..operators.rules import Rule
from ..sources import tables as S
from .queries import HALF_UP, WORDS
from .rules import _lit, findings_sql

PASSAGES = (
    "# Новый Быстрый Умный Поиск\n\nМы не ищем слова, а находим смысл — быстро — и просто — всегда. Кто это сделал? Зачем? Почему сейчас?\n\nКроме того, рост виден.\n\nТакже растёт спрос.\n\nОднако есть риск.",
    "## 🚀 Запуск\n\n**Раз** и **два** и **три** и **четыре** и **пять**. Решение принято. Проект создан. Отчёт написан. План утверждён.\n\n- быстрый старт\n- простой вход\n- полный обзор\n- ясный итог\n- новый взгляд\n",
    "Без воды, без лишних слов, без обмана. Повышение эффективности реализации деятельности организации важно.\n\nВот готовый вариант текста:\n\nЦена 12 рублей, вес 3 кг; срок 5 дней. Смотри [1] и «цитату» тут.",
    "<!-- off -->\nскрыто\n<!-- on -->\nСлово cмысл и ещё тeкст с подменой букв. <think>мысль</think> Формула $a+b$ и ссылка https://example.org/x.\n\n| a | b |\n| 1 | 2 |\n\n> чужие слова",
    "Ещё ёлка. Это одно. Это два. Это три. Самый важный, самый полный, очень яркий итог\n\nМы пришли сюда вчера вечером и решили продолжить работу над тем, что",
    "Това е български текст със съвсем други думи и букви, който не е руски.\n\nОбычный русский текст, в котором есть буквы ы и э, и ещё кое-что.",
)
BLOCK = "\n[ \t]*\n"
# Kinds of blocks by their first signs.
KINDS = {"heading": "^#{1,6} ", "list": r"^\s*(?:[-*+]|[0-9]+[.)]) ", "quote": "^>", "table": r"^\|"}
HEADING = r"(?m)^#{1,6} [^\n]*$"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
PROTECTED = r"<!--[^>]*-->|\$[^$\n]+\$|https?://[^\s)]+|«[^»\n]*»|\[[0-9]+\]"
OFF = r"(?s)<!-- off -->.*?(?:<!-- on -->|\z)"
MARKUP = ((r"(?m)^#{1,6} ", ""), (r"\*\*([^*\n]+)\*\*", "X1"), (r"`([^`\n]+)`", "X1"), (r"<[^>\n]+>", ""), (r"(?m)^> ?", ""), (r"(?m)^\|.*\|$", ""), ("[ \t]+", " "))
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
PASSIVE, OPENER = "(?i)(?:принято|создан|написан|утвержд[её]н|сделано)", "(?i)^(?:кроме того|также|однако|более того)"
DEVERBAL, SHORT, VERB = "(?:ния|сти|ции|ение)$", 4, "(?i)(?:ть|ет|ит|ют|ал)$"
TAIL = r"\S+(?:\s+\S+){0,5}$"
DANGLING = r"(?:,|(?i:\s(?:что|и|а|но|в|на)))\s*$"
BLANKS = " \t\n\f\r"
RULES = [
    Rule("not-x-but-y", "not-x-but-y", "P1", "(?iu)не [^,.\n]{1,40}, а "),
    Rule("negation-chain", "negation-chain", "P1", "(?iu)без [^,.\n]{1,30}, без [^,.\n]{1,30}"),
    Rule("chat-markup", "chat-markup", "P0", "</?think>"),
    Rule("lead-in", "chat-wrapper", "P0", "(?iu)вот (?:готовый|новый) вариант[^\n]*:"),
    Rule("angle-quotes", "typography", "P2", "«[^»\n]*»"),
    Rule("dash", "typography", "P2", r"\p{L} — \p{L}"),
    Rule("hidden-quote", "typography", "P2", "[„“][^„“”\n]*[“”]"),
]


def _marked(spark, sf_dir) -> DataFrame:
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int") + 1)
    return S.table(spark, sf_dir, "documents").select("doc_id", F.concat(passage, F.lit("\n\n"), F.col("text")).alias("text"))


def _blocks(text: Column) -> Column:
    return F.filter(F.split(text, BLOCK), lambda b: F.trim(b) != "")


def _kind(block: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        out = F.when(block.rlike(pattern), name) if out is None else out.when(block.rlike(pattern), name)
    return out.otherwise("prose")


def _prose(text: Column) -> Column:
    return F.filter(_blocks(text), lambda b: _kind(b) == "prose")


def _n(x: Column) -> Column:
    return F.size(T.words(x))


def _ends(pattern: str) -> str:
    """The pattern with the blanks and the end of a text that SQL knows: no vertical tab, and no place before a line's end."""
    return pattern.replace(r"\s", f"[{BLANKS}]").replace(r"\S", f"[^{BLANKS}]").replace("$", r"\z")


def _spans(name: str):
    """One rule's findings with their places."""
    some = [r for r in RULES if r.name == name]

    def query(spark, sf_dir):
        return rules.findings(_marked(spark, sf_dir), some)

    return query, findings_sql(MARKED_SQL, some)


def paragraphs(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("doc_id", F.posexplode(_blocks(F.col("text"))).alias("pos", "b"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), _kind(F.col("b")).alias("kind"), F.length("b").cast("long").alias("n_chars"), _n(F.col("b")).cast("long").alias("n_words"))


def paragraph_cv(spark, sf_dir):
    sizes = F.filter(F.transform(_prose(F.col("text")), lambda b: _n(b).cast("long")), lambda n: n >= 15)
    rows = _marked(spark, sf_dir).select("doc_id", sizes.alias("z"))
    mean, cv = style.spread(F.col("z"))
    return rows.select("doc_id", F.size("z").cast("long").alias("n_paragraphs"), mean.alias("mean_words"), cv.alias("cv"), F.coalesce((F.size("z") >= 5) & (cv < 0.2), F.lit(False)).alias("uniform"))


def doc_stats(spark, sf_dir):
    text = F.col("text")
    sizes = F.filter(F.transform(T.sentences(text), lambda s: _n(s).cast("long")), lambda n: n >= 3)
    rows = _marked(spark, sf_dir).select("doc_id", F.transform(T.words(text), F.lower).alias("w"), sizes.alias("z"), F.size(T.sentences(text)).cast("long").alias("n_sentences"), F.size(_prose(text)).cast("long").alias("n_paragraphs"))
    mean, cv = style.spread(F.col("z"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), "n_sentences", "n_paragraphs", T.rounded(mean, 2).alias("mean_sentence"), F.coalesce(T.rounded(cv, 3), F.lit(0.0)).alias("cv_sentence"))


def dash_splice(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(r"\p{L} — ")).cast("long").alias("n"), _n(F.col("text")).cast("long").alias("n_words"))
    return rows.where("n > 1 and n * 500 > n_words")


def title_case(spark, sf_dir):
    lines = F.filter(F.regexp_extract_all("text", F.lit(HEADING), F.lit(0)), lambda h: F.size(F.filter(T.words(h), lambda w: F.length(w) >= 4)) >= 3)
    all_ = F.filter(lines, lambda h: F.forall(F.filter(T.words(h), lambda w: F.length(w) >= 4), lambda w: w.rlike(r"^\p{Lu}")))
    return _marked(spark, sf_dir).select("doc_id", F.explode(all_).alias("heading"))


def emoji_header(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.explode(F.filter(F.regexp_extract_all("text", F.lit(HEADING), F.lit(0)), lambda h: h.rlike(EMOJI))).alias("heading"))


def bold_overuse(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", HEADING)).alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), F.regexp_count("s", F.lit(r"\*\*[^*\n]+\*\*")).cast("long").alias("n")).where("n > 3")


def genitive_chain(spark, sf_dir):
    return style.run_rows(_marked(spark, sf_dir), F.transform(T.words(F.col("text")), lambda w: style.where(F.lower(w).rlike(DEVERBAL))), 3)


def passive_run(spark, sf_dir):
    return style.run_rows(_marked(spark, sf_dir), F.transform(T.sentences(F.col("text")), lambda s: style.where(s.rlike("(?u)" + PASSIVE))), 3)


def transition_run(spark, sf_dir):
    return style.run_rows(_marked(spark, sf_dir), F.transform(_prose(F.col("text")), lambda b: style.where(b.rlike("(?u)" + OPENER))), 3)


def stacked_questions(spark, sf_dir):
    return style.run_rows(_marked(spark, sf_dir), F.transform(T.sentences(F.col("text")), lambda s: style.where(s.rlike(r"\?\s*$"))), 3)


def bullet_np_list(spark, sf_dir):
    items = F.filter(F.split("text", "\n"), lambda x: x.rlike(KINDS["list"]))
    short = F.filter(items, lambda x: (_n(x) <= SHORT) & ~F.exists(T.words(x), lambda w: w.rlike("(?u)" + VERB)))
    rows = _marked(spark, sf_dir).select("doc_id", F.size(items).cast("long").alias("n_items"), F.size(short).cast("long").alias("n_short"))
    return rows.where("n_items >= 5 and n_short >= 5 and n_short * 10 >= n_items * 8")


def truncated_tail(spark, sf_dir):
    """Texts, every other one with a passage of our own behind it, whose last block is prose and whose last line of eight
    words or more ends with a comma or a word no sentence ends with: its last six words and their place."""
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int") + 1)
    whole = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat("text", F.lit("\n\n"), passage)).otherwise(F.col("text"))
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.rtrim(whole, F.lit(BLANKS)).alias("text"))
    # A blank text has no block.
    rows = once(rows, b=F.try_element_at(_blocks(F.col("text")), F.lit(-1)))
    line = F.element_at(F.split("b", "\n"), -1)
    found = rows.where((_kind(F.col("b")) == "prose") & (_n(line) >= 8) & line.rlike("(?u)" + _ends(DANGLING)))
    # TAIL from the beginning of a word: no other place is tried, and no blank is read twice.
    tail = F.regexp_extract(line, _ends(r"(?<!\S)" + TAIL.replace("+", "++")), 0)
    return found.select("doc_id", (F.length("text") - F.length(tail)).cast("long").alias("start"), tail.alias("tail"))


def fp_homoglyph(spark, sf_dir):
    """Words of Cyrillic letters with Latin ones that look alike, and their repaired forms."""
    mixed = F.filter(T.words(F.col("text")), lambda w: w.rlike(r"\p{IsCyrillic}") & w.rlike("[aceopxyABCEHKMOPTX]"))
    rows = _marked(spark, sf_dir).select("doc_id", F.explode(mixed).alias("word"))
    # Latin letters and the Cyrillic ones they look like.
    return rows.select("doc_id", "word", F.translate("word", "aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ").alias("repaired"))


def ignore_regions(spark, sf_dir):
    kept = F.regexp_replace("text", OFF, "")
    return _marked(spark, sf_dir).select("doc_id", F.length(kept).cast("long").alias("n_kept"), (F.length("text") - F.length(kept)).cast("long").alias("n_ignored"))


def mask_protected(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.sha2(spans.blanked(F.col("text"), PROTECTED).cast("binary"), 256).alias("masked_sha256"))


def cyrillic_share(spark, sf_dir):
    a, b = (T.letters(F.col("text"), x) for x in ("Cyrillic", "Latin"))
    return _marked(spark, sf_dir).select("doc_id", F.when(a + b > 0, T.rounded(a / (a + b), 6)).alias("share"))


def _language(text: Column) -> Column:
    """ru, other or uncertain by the share of Cyrillic letters and by letters that one language has and another lacks."""
    a, b = (T.letters(text, x) for x in ("Cyrillic", "Latin"))
    own, hard = F.regexp_count(text, F.lit("[ыэёЫЭЁ]")), F.regexp_count(text, F.lit(r"[ъЪ](?:[^еёюяЕЁЮЯ]|$)"))
    foreign = hard + F.regexp_count(text, F.lit("[іїєґўјљњћђџІЇЄҐЎЈЉЊЋЂЏ]"))
    # A half, 1 %, 0.4 %, three times, 400 and 40 letters.
    return (
        F.when((a + b == 0) | (a * 2 < a + b), "other")
        .when((foreign >= 2) & (foreign * 100 >= a), F.when((own * 1000 < a * 4) | (foreign >= own * 3), "other").otherwise("uncertain"))
        .when(own == 0, F.when(a >= 400, "other").when((foreign == 0) & (a < 40), "uncertain").otherwise("ru"))
        .otherwise("ru")
    )


def language_id(spark, sf_dir):
    part = F.element_at(F.array(*map(F.lit, PASSAGES)), F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int") + 1)
    return S.table(spark, sf_dir, "documents").select("doc_id", _language(part).alias("language"), _language(F.col("text")).alias("language_of_text"))


def foreign_paragraphs(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("doc_id", F.posexplode(_blocks(F.col("text"))).alias("pos", "b"))
    letters = T.letters(F.col("b"), "Cyrillic") + T.letters(F.col("b"), "Latin")
    return rows.where((letters >= 20) & (_language(F.col("b")) == "other")).select("doc_id", F.col("pos").cast("long").alias("pos"), letters.cast("long").alias("n_letters"))


def normalize_markup(spark, sf_dir):
    out = F.col("text")
    for pattern, new in MARKUP:
        out = F.regexp_replace(out, pattern, new.replace("X", "$"))
    return _marked(spark, sf_dir).select("doc_id", F.sha2(F.trim(out).cast("binary"), 256).alias("plain_sha256"))


def match_tokens(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "w"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.translate(F.lower("w"), "ё", "е").alias("token"))


def number_parts(spark, sf_dir):
    """Parts between clause borders that hold exactly one number."""
    parts = F.filter(F.split("text", r"[;!?\n]|[.,] "), lambda p: F.size(F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0))) == 1)
    rows = _marked(spark, sf_dir).select("doc_id", F.explode(parts).alias("part"))
    return rows.select("doc_id", F.trim("part").alias("part"), F.regexp_extract("part", NUMBER, 0).alias("number"))


QUERIES = {f.__name__: f for f in (paragraphs, paragraph_cv, doc_stats, dash_splice, title_case, emoji_header, bold_overuse, genitive_chain, passive_run, transition_run, stacked_questions, bullet_np_list, truncated_tail, fp_homoglyph, ignore_regions, mask_protected, cyrillic_share, language_id, foreign_paragraphs, normalize_markup, match_tokens, number_parts)}

MARKED_SQL = f"SELECT doc_id, [{', '.join(map(_lit, PASSAGES))}][doc_id % {len(PASSAGES)} + 1] || chr(10) || chr(10) || text AS text FROM documents"
_W = lambda x: WORDS.replace("text,", f"{x},")
_SENT = rf"list_filter(string_split(regexp_replace(text, '([.!?…]+)\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: len({_W('s')}) > 0)"
_BL = f"list_filter(string_split_regex(text, {_lit(BLOCK)}), lambda b: trim(b) <> '')"
_K = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, {_lit(p)}) THEN {_lit(k)}" for k, p in KINDS.items()) + " ELSE 'prose' END"
_PR = f"list_filter({_BL}, lambda b: ({_K('b')}) = 'prose')"
_ONE = f"[{', '.join(map(_lit, PASSAGES))}][doc_id % {len(PASSAGES)} + 1]"
_H = f"regexp_extract_all(text, {_lit(HEADING)})"
_SP = lambda z: f"""CAST(len({z}) AS BIGINT) AS n, CASE WHEN len({z}) > 0 THEN {HALF_UP(f"list_sum({z}) / len({z})", 4)} END AS mean, CASE WHEN len({z}) > 1 THEN {HALF_UP(f"sqrt(greatest(0.0, (list_sum(list_transform({z}, lambda x: x * x)) - list_sum({z}) * list_sum({z}) / len({z})) / (len({z}) - 1))) / (list_sum({z}) / len({z}))", 4)} END AS cv"""


def _runs_sql(elements: str, flag: str, least: int) -> str:
    return f"""SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (
      SELECT doc_id, pos, e[pos + 1] AS q FROM (SELECT doc_id, e, unnest(range(len(e))) AS pos FROM (SELECT doc_id, {elements} AS e FROM ({MARKED_SQL})))) WHERE {flag}) GROUP BY doc_id, g HAVING count(*) >= {least}"""


def _language_sql(x: str) -> str:
    count = lambda p: f"len(regexp_extract_all({x}, {_lit(p)}))"
    a, b, own = count(r"\p{Cyrillic}"), count(r"\p{Latin}"), count("[ыэёЫЭЁ]")
    foreign = f"({count(r'[ъЪ](?:[^еёюяЕЁЮЯ]|$)')} + {count('[іїєґўјљњћђџІЇЄҐЎЈЉЊЋЂЏ]')})"
    return f"""CASE WHEN {a} + {b} = 0 OR {a} * 2 < {a} + {b} THEN 'other' WHEN {foreign} >= 2 AND {foreign} * 100 >= {a} THEN CASE WHEN {own} * 1000 < {a} * 4 OR {foreign} >= {own} * 3 THEN 'other' ELSE 'uncertain' END
      WHEN {own} = 0 THEN CASE WHEN {a} >= 400 THEN 'other' WHEN {foreign} = 0 AND {a} < 40 THEN 'uncertain' ELSE 'ru' END ELSE 'ru' END"""


_plain = "text"
for _p, _new in MARKUP:
    _plain = f"regexp_replace({_plain}, {_lit(_p)}, {_lit(_new.replace('X', chr(92)))}, 'g')"
ORACLE_SQL = {
    "paragraphs": f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_K('q')} AS kind, CAST(length(q) AS BIGINT) AS n_chars, CAST(len({_W('q')}) AS BIGINT) AS n_words FROM (SELECT doc_id, pos, b[pos + 1] AS q FROM (SELECT doc_id, b, unnest(range(len(b))) AS pos FROM (SELECT doc_id, {_BL} AS b FROM ({MARKED_SQL}))))",
    "paragraph_cv": f"SELECT doc_id, n AS n_paragraphs, mean AS mean_words, cv, coalesce(n >= 5 AND cv < 0.2, false) AS uniform FROM (SELECT doc_id, {_SP('z')} FROM (SELECT doc_id, list_filter(list_transform({_PR}, lambda b: len({_W('b')})), lambda n: n >= 15) AS z FROM ({MARKED_SQL})))",
    "doc_stats": f"SELECT doc_id, n_words, n_sentences, n_paragraphs, {HALF_UP('mean', 2)} AS mean_sentence, coalesce({HALF_UP('cv', 3)}, 0.0) AS cv_sentence FROM (SELECT doc_id, n_words, n_sentences, n_paragraphs, {_SP('z')} FROM (SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n_words, CAST(len({_SENT}) AS BIGINT) AS n_sentences, CAST(len({_PR}) AS BIGINT) AS n_paragraphs, list_filter(list_transform({_SENT}, lambda s: len({_W('s')})), lambda n: n >= 3) AS z FROM ({MARKED_SQL})))",
    "dash_splice": rf"SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{{L}} — ')) AS BIGINT) AS n, CAST(len({WORDS}) AS BIGINT) AS n_words FROM ({MARKED_SQL})) WHERE n > 1 AND n * 500 > n_words",
    "title_case": rf"SELECT doc_id, h AS heading FROM (SELECT doc_id, h, list_filter({_W('h')}, lambda w: length(w) >= 4) AS w FROM (SELECT doc_id, unnest({_H}) AS h FROM ({MARKED_SQL}))) WHERE len(w) >= 3 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\p{{Lu}}'))) = 0",
    "emoji_header": f"SELECT doc_id, h AS heading FROM (SELECT doc_id, unnest({_H}) AS h FROM ({MARKED_SQL})) WHERE regexp_matches(h, {_lit(EMOJI)})",
    "bold_overuse": rf"SELECT doc_id, CAST(section AS BIGINT) AS section, n FROM (SELECT doc_id, section, CAST(len(regexp_extract_all(s[section + 1], '\*\*[^*\n]+\*\*')) AS BIGINT) AS n FROM (SELECT doc_id, s, unnest(range(len(s))) AS section FROM (SELECT doc_id, string_split_regex(text, {_lit(HEADING)}) AS s FROM ({MARKED_SQL})))) WHERE n > 3",
    "genitive_chain": _runs_sql(WORDS, f"regexp_matches(lower(q), {_lit(DEVERBAL)})", 3),
    "passive_run": _runs_sql(_SENT, f"regexp_matches(q, {_lit(PASSIVE)})", 3),
    "transition_run": _runs_sql(_PR, f"regexp_matches(q, {_lit(OPENER)})", 3),
    "stacked_questions": _runs_sql(_SENT, r"regexp_matches(q, '\?\s*$')", 3),
    "bullet_np_list": f"SELECT * FROM (SELECT doc_id, CAST(len(i) AS BIGINT) AS n_items, CAST(len(list_filter(i, lambda x: len({_W('x')}) <= {SHORT} AND len(list_filter({_W('x')}, lambda w: regexp_matches(w, {_lit(VERB)}))) = 0)) AS BIGINT) AS n_short FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_lit(KINDS['list'])})) AS i FROM ({MARKED_SQL}))) WHERE n_items >= 5 AND n_short >= 5 AND n_short * 10 >= n_items * 8",
    "truncated_tail": rf"""SELECT doc_id, CAST(length(text) - length(regexp_extract(l, {_lit(TAIL)})) AS BIGINT) AS start, regexp_extract(l, {_lit(TAIL)}) AS tail
      FROM (SELECT doc_id, text, b, string_split(b, chr(10))[-1] AS l FROM (SELECT doc_id, text, {_BL}[-1] AS b FROM (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || {_ONE} ELSE '' END, '\s+$', '') AS text FROM documents)))
      WHERE ({_K('b')}) = 'prose' AND len({_W('l')}) >= 8 AND regexp_matches(l, {_lit(DANGLING)})""",
    "fp_homoglyph": rf"SELECT doc_id, w AS word, translate(w, 'aceopxyABCEHKMOPTX', 'асеорхуАВСЕНКМОРТХ') AS repaired FROM (SELECT doc_id, unnest({WORDS}) AS w FROM ({MARKED_SQL})) WHERE regexp_matches(w, '\p{{Cyrillic}}') AND regexp_matches(w, '[aceopxyABCEHKMOPTX]')",
    "ignore_regions": f"SELECT doc_id, CAST(length(k) AS BIGINT) AS n_kept, CAST(length(text) - length(k) AS BIGINT) AS n_ignored FROM (SELECT doc_id, text, regexp_replace(text, {_lit(OFF)}, '', 'g') AS k FROM ({MARKED_SQL}))",
    "mask_protected": f"SELECT doc_id, sha256(array_to_string(list_transform(g, lambda x, i: x || coalesce(regexp_replace(h[i], '[^\\n]', ' ', 'g'), '')), '')) AS masked_sha256 FROM (SELECT doc_id, string_split_regex(text, {_lit(PROTECTED)}) AS g, regexp_extract_all(text, {_lit(PROTECTED)}) AS h FROM ({MARKED_SQL}))",
    "cyrillic_share": rf"SELECT doc_id, CASE WHEN a + b > 0 THEN {HALF_UP('a / (a + b)', 6)} END AS share FROM (SELECT doc_id, len(regexp_extract_all(text, '\p{{Cyrillic}}')) AS a, len(regexp_extract_all(text, '\p{{Latin}}')) AS b FROM ({MARKED_SQL}))",
    "language_id": f"SELECT doc_id, {_language_sql('p')} AS language, {_language_sql('text')} AS language_of_text FROM (SELECT doc_id, text, {_ONE} AS p FROM documents)",
    "foreign_paragraphs": rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n_letters FROM (SELECT doc_id, pos, q, len(regexp_extract_all(q, '\p{{Cyrillic}}')) + len(regexp_extract_all(q, '\p{{Latin}}')) AS n FROM (SELECT doc_id, pos, b[pos + 1] AS q FROM (SELECT doc_id, b, unnest(range(len(b))) AS pos FROM (SELECT doc_id, {_BL} AS b FROM ({MARKED_SQL}))))) WHERE n >= 20 AND ({_language_sql('q')}) = 'other'",
    "normalize_markup": f"SELECT doc_id, sha256(trim({_plain})) AS plain_sha256 FROM ({MARKED_SQL})",
    "match_tokens": f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, replace(lower(w[pos + 1]), 'ё', 'е') AS token FROM (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM ({MARKED_SQL})))",
    "number_parts": rf"SELECT doc_id, trim(p) AS part, regexp_extract(p, {_lit(NUMBER)}) AS number FROM (SELECT doc_id, unnest(string_split_regex(text, '[;!?\n]|[.,] ')) AS p FROM ({MARKED_SQL})) WHERE len(regexp_extract_all(p, {_lit(NUMBER)})) = 1",
}
for _name, _key in (("not-x-but-y", "not_x_but_y"), ("negation-chain", "negation_chain"), ("chat-markup", "fp_chat_markup"), ("lead-in", "lead_in"), ("angle-quotes", "quotes_angle"), ("dash", "dash_spans")):
    QUERIES[_key], ORACLE_SQL[_key] = _spans(_name)
