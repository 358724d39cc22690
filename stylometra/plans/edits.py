"""Queries of the checks that compare an edit's words in their context, and their DuckDB SQL.

The pairs are passages of our own with an edit of each, before every document's whole text; in the edited side the
document's last sentence stands first, which none of the checks may take for a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits as E
from ..sources import tables as S

#: passages before and after an edit
PASSAGES = (
    ("Ольга испекла 14 пирогов, Павел 9 тортов. Сервер не отвечает.", "Ольга испекла 9 пирогов, Павел 14 тортов. Сервер отвечает."),
    ("Ольга испекла 14 пирогов, Павел 9 тортов. Игорь не закрыл заявку.", "Игорь не закрыл заявку. Павел испёк 9 тортов, Ольга 14 пирогов."),
    ("В Орле продали 120 ламп, в Пскове 340 чашек, в Томске 560 тарелок.", "В Орле продали 340 ламп, в Пскове 560 чашек, в Томске 120 тарелок."),
    ("1. Ольга нашла 1 200 марок.\n2. Павел нашёл 800 монет.", "1. Павел нашёл 800 монет.\n2. Ольга нашла 1 200 марок."),
    ("Вчера Игорь отдал папку Марине. Длина 12 метров, вес 5 кг.", "Вчера Игорю отдала папку Марина. Длина 12 сантиметров, вес 5 килограммов."),
    ("По словам Зимина и Лужина, мост открыт. Дождь не пошёл 3 часа.", "Сегодня Зимин и Лужин сказали, что мост открыт. Дождь пошёл 3 дня."),
    ("Склад принял 1 250,5 тонны зерна; порт отгрузил 730 тонн угля.", "Склад принял 730 тонн зерна; порт отгрузил 1 250,5 тонны угля. Не только порт."),
)


def _pairs(spark, sf_dir) -> DataFrame:
    side = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in PASSAGES)), F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int") + 1)
    parts = F.split(F.coalesce("text", F.lit("")), r"\. ")
    moved = F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -1), F.lit(". "), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ". "))).otherwise(F.coalesce("text", F.lit("")))
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(side(0), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("before"), F.concat(side(1), F.lit("\n\n"), moved).alias("after"))


def v_swaps(spark, sf_dir):
    """Closed exchanges of numbers between their contexts."""
    rows = E.number_swaps(_pairs(spark, sf_dir)).select("doc_id", F.explode("swaps").alias("s"))
    return rows.select("doc_id", F.array_join("s.numbers", " | ").alias("numbers"), "s.was", "s.now")


def v_negation(spark, sf_dir):
    """Words that gained or lost a negation."""
    return E.negation_flips(_pairs(spark, sf_dir)).select("doc_id", F.explode("flips").alias("f")).select("doc_id", "f.change", "f.particle", "f.word")


def v_roles(spark, sf_dir):
    """Names whose case changed, where two roles at least did."""
    return E.role_changes(_pairs(spark, sf_dir)).select("doc_id", F.explode("roles").alias("r")).select("doc_id", "r.was", "r.now")


def v_unit_changes(spark, sf_dir):
    """Numbers whose unit changed."""
    return E.changed_units(_pairs(spark, sf_dir)).select("doc_id", F.explode("units").alias("u")).select("doc_id", "u.number", "u.was", "u.now")


QUERIES = {f.__name__: f for f in (v_swaps, v_negation, v_roles, v_unit_changes)}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_lit, words)) + ")"


_SIDE = lambda k: f"[{', '.join(_lit(p[k]) for p in PASSAGES)}][doc_id % {len(PASSAGES)} + 1]"
_PAIRS = f"""SELECT doc_id, {_SIDE(0)} || chr(10) || chr(10) || text AS before,
  {_SIDE(1)} || chr(10) || chr(10) || CASE WHEN len(p) > 1 THEN p[-1] || '. ' || array_to_string(p[1:-2], '. ') ELSE text END AS after
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), '. ') AS p FROM documents)"""
_BOTH = f"p0 AS ({_PAIRS}), sides AS (SELECT doc_id, 'before' AS side, before AS text FROM p0 UNION ALL SELECT doc_id, 'after', after FROM p0)"


def _stem(a: str, b: str) -> str:
    short = f"least(length({a}), length({b}))"
    begin = lambda n: f"left({a}, CAST({n} AS BIGINT)) = left({b}, CAST({n} AS BIGINT))"
    return f"(CASE WHEN {short} <= 3 THEN {begin(short)} AND abs(length({a}) - length({b})) <= 3 ELSE {begin(f'greatest(3, {short} - 2)')} END)"


_TOKENS = f"{_BOTH}, tokens AS (SELECT doc_id, side, i, w, lag(w) OVER (PARTITION BY doc_id, side ORDER BY i) AS previous FROM (SELECT doc_id, side, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, side, list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x)) AS w FROM sides)))"
_FLIPS = lambda change, here, there: f"""SELECT DISTINCT doc_id, '{change}' AS change, previous AS particle, w AS word FROM negated a WHERE side = '{here}' AND w NOT IN {_list(E.NEGATION_IDIOMS)}
  AND NOT EXISTS (SELECT 1 FROM negated b WHERE b.doc_id = a.doc_id AND b.side = '{there}' AND {_stem('a.w', 'b.w')}) AND EXISTS (SELECT 1 FROM plain b WHERE b.doc_id = a.doc_id AND b.side = '{there}' AND {_stem('a.w', 'b.w')})"""  # noqa: E731
_UNIT_NAMES = [*E.UNIT_ABBREVIATIONS, *(f for some in E.UNIT_FORMS.values() for f in some)]
_UNIT = lambda w: "CASE " + " ".join(f"WHEN {w} = {_lit(k)} THEN {_lit(v)}" for k, v in E.UNIT_ABBREVIATIONS.items()) + " " + " ".join(f"WHEN {w} IN {_list(v)} THEN {_lit(k)}" for k, v in E.UNIT_FORMS.items()) + " " + " ".join(f"WHEN starts_with({w}, {_lit(s)}) THEN {_lit(s)}" for s in E.UNIT_STEMS) + " END"
_LEAD = r"(^|\n)[^\p{L}\p{N}\n]*(?:[0-9]{1,3}[.)][^\p{L}\p{N}\n]*)?"
#: RE2 has no look-around: the end of a run of digits gets a mark of its own, and parts end at marks
_SPACES = r"\x{00A0}\x{202F}"  # besides plain blanks
_DIGITS = r"(?:[0-9]{1,3}(?:~[ @][0-9]{3})+~|[0-9]+~)(?:[.,][0-9]+~)*".replace("~", "\x1f").replace("@", _SPACES)
_NUMBERS = rf"(?:^|[^\p{{L}}\p{{N}}.,])({_DIGITS})"
_CUT = "text"
for _pattern, _by in ((_LEAD, r"\1"), (r"[.!?…]+(\s|$)", "\x1e" + r"\1"), (r"[;\n]", "\x1e"), (r",([^0-9]|$)", "\x1e" + r"\1"), (r"(?i)\s(?:и|а|но|или)\s", "\x1e")):
    _CUT = f"regexp_replace({_CUT}, {_lit(_pattern)}, {_lit(_by)}, 'g')"
_ANCHOR = f"length(x) >= 2 AND x NOT IN {_list(E.FUNCTION_WORDS)} AND x NOT IN {_list(E.COUNTING)} AND NOT regexp_matches(x, '^(?:{'|'.join(E.COUNTING_STEMS)})') AND x NOT IN {_list(_UNIT_NAMES)} AND NOT regexp_matches(x, '^(?:{'|'.join(E.UNIT_STEMS)})')"
_FREE = lambda words, others: f"len(list_filter({others}, lambda o: {_stem(words, 'o')})) = 0"
_SWAPS = rf"""WITH RECURSIVE {_BOTH}, pieces AS (
  SELECT doc_id, side, i, piece, list_transform(regexp_extract_all(regexp_replace(piece, '([0-9])([^0-9]|$)', '\1' || chr(31) || '\2', 'g'), {_lit(_NUMBERS)}, 1), lambda x: replace(x, chr(31), '')) AS numbers
  FROM (SELECT doc_id, side, unnest(s) AS piece, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, side, string_split({_CUT}, chr(30)) AS s FROM sides))
), keyed AS (
  SELECT doc_id, side, i, regexp_replace(regexp_extract(piece, '(?s)[\p{{L}}\p{{N}}](?:.*[\p{{L}}\p{{N}}])?'), '[\s{_SPACES}]+', ' ', 'g') AS part, regexp_replace(numbers[1], '[\s{_SPACES}]+', ' ', 'g') AS number,
    list_transform(numbers, lambda x: replace(regexp_replace(x, '[\s{_SPACES}]+', '', 'g'), ',', '.')) AS keys, list_filter(list_transform(regexp_extract_all(piece, '\p{{L}}+'), lambda x: lower(x)), lambda x: {_ANCHOR}) AS words
  FROM pieces WHERE len(numbers) > 0
), counts AS (SELECT doc_id, side, k, count(*) AS n FROM (SELECT doc_id, side, unnest(keys) AS k FROM keyed) GROUP BY ALL),
lone AS (SELECT keyed.*, keys[1] AS k FROM keyed JOIN counts c USING (doc_id, side) WHERE len(keys) = 1 AND c.k = keys[1] AND c.n = 1),
common AS (SELECT b.doc_id, b.k, b.i, b.number, b.words, b.part AS was, a.part AS now, a.words AS after FROM lone b JOIN lone a ON a.doc_id = b.doc_id AND a.k = b.k AND b.side = 'before' AND a.side = 'after'),
options AS (
  SELECT x.doc_id, x.k, o.k AS other, len(list_filter(o.words, lambda w: {_FREE('w', 'x.words')} AND NOT {_FREE('w', 'x.after')})) AS n, list_filter(x.words, lambda w: {_FREE('w', 'o.words')}) AS own, x.after
  FROM common x JOIN common o ON x.doc_id = o.doc_id AND x.k <> o.k WHERE len(list_filter(x.words, lambda w: {_FREE('w', 'x.after')})) > 0
), best AS (SELECT doc_id, k, other, n, row_number() OVER w AS r, lead(n) OVER w AS following FROM options WHERE n > 0 AND len(own) > 0 AND len(list_filter(own, lambda w: NOT {_FREE('w', 'after')})) = 0 WINDOW w AS (PARTITION BY doc_id, k ORDER BY n DESC, other DESC)),
moves AS (SELECT doc_id, k, other FROM best WHERE r = 1 AND n > coalesce(following, 0)),
walks AS (SELECT doc_id, k AS origin, [k] AS seen, other AS target FROM moves UNION ALL SELECT w.doc_id, origin, list_append(seen, w.target), m.other FROM walks w JOIN moves m ON m.doc_id = w.doc_id AND m.k = w.target WHERE NOT list_contains(seen, w.target)),
cycles AS (SELECT doc_id, origin, seen FROM walks WHERE target = origin),
ordered AS (SELECT c.doc_id, c.origin, string_agg(x.number, ' | ' ORDER BY x.i) AS numbers, arg_min(x.k, x.i) AS lowest, arg_min(x.was, x.i) AS was, arg_min(x.now, x.i) AS now FROM cycles c JOIN common x ON x.doc_id = c.doc_id AND list_contains(c.seen, x.k) GROUP BY c.doc_id, c.origin)
SELECT doc_id, numbers, was, now FROM ordered WHERE origin = lowest"""
_CAPITALS = rf"""caps AS (
  SELECT doc_id, side, list_filter(found, lambda x: regexp_matches(ltrim(x, chr(30)), '^\p{{Lu}}\P{{Lu}}') AND NOT regexp_matches(x, '\p{{Latin}}')) AS c
  FROM (SELECT doc_id, side, regexp_extract_all(regexp_replace(text, {_lit(E.STARTS)}, '\0' || chr(30), 'g'), chr(30) || '?\p{{L}}+') AS found FROM sides)
), cap AS (SELECT doc_id, side, i, ltrim(x, chr(30)) AS word, starts_with(x, chr(30)) AS at_start FROM (SELECT doc_id, side, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM caps))"""
_JOINED = lambda text, a, b: rf"regexp_matches(lower({text}), '(?:^|[^\p{{L}}\p{{N}}_])(?:' || lower({a}) || {_lit(E.JOINTS)} || lower({b}) || '|' || lower({b}) || {_lit(E.JOINTS)} || lower({a}) || ')(?:[^\p{{L}}\p{{N}}_]|$)')"
_ROLES = f"""WITH RECURSIVE {_BOTH}, {_CAPITALS},
inner_names AS (SELECT doc_id, list([lower(word)] ORDER BY side DESC, i) AS n FROM cap WHERE NOT at_start GROUP BY doc_id),
names AS (SELECT doc_id, unnest(reps) AS name, generate_subscripts(reps, 1) AS r FROM (SELECT doc_id, list_reduce(n, lambda seen, x: CASE WHEN len(list_filter(seen, lambda s: {_stem('s', 'x[1]')})) > 0 THEN seen ELSE list_concat(seen, x) END) AS reps FROM inner_names)),
forms AS (SELECT n.doc_id, n.r, c.side, c.word, min(c.i) AS i FROM names n JOIN cap c ON c.doc_id = n.doc_id AND {_stem('lower(c.word)', 'n.name')} GROUP BY ALL),
gone AS (SELECT doc_id, r, side, arg_min(word, i) AS word FROM forms f WHERE NOT EXISTS (SELECT 1 FROM forms g WHERE g.doc_id = f.doc_id AND g.r = f.r AND g.side <> f.side AND g.word = f.word) GROUP BY ALL),
changed AS (SELECT b.doc_id, b.r, b.word AS was, a.word AS now FROM gone b JOIN gone a ON a.doc_id = b.doc_id AND a.r = b.r AND b.side = 'before' AND a.side = 'after'),
links AS (SELECT x.doc_id, x.r AS a, y.r AS b FROM changed x JOIN changed y ON x.doc_id = y.doc_id JOIN p0 ON p0.doc_id = x.doc_id WHERE x.r = y.r OR {_JOINED('p0.before', 'x.was', 'y.was')} OR {_JOINED('p0.after', 'x.now', 'y.now')}),
reach AS (SELECT doc_id, a, b FROM links UNION SELECT r.doc_id, r.a, l.b FROM reach r JOIN links l ON l.doc_id = r.doc_id AND l.a = r.b),
grouped AS (SELECT doc_id, count(DISTINCT low) AS n FROM (SELECT doc_id, a, min(b) AS low FROM reach GROUP BY doc_id, a) GROUP BY doc_id)
SELECT doc_id, was, now FROM changed JOIN grouped USING (doc_id) WHERE n >= {E.LEAST_ROLES}"""
_NUMBER_UNIT = _lit(r"(?:^|[^0-9.,])([0-9]+(?:[.,][0-9]+)?)\s?(%|₽|\$|€|\p{L}+)")
_UNITS = f"""WITH {_BOTH}, u AS (
  SELECT doc_id, side, replace(n, ',', '.') AS number, w AS word, {_UNIT('lower(w)')} AS unit, i FROM (
    SELECT doc_id, side, unnest(regexp_extract_all(text, {_NUMBER_UNIT}, 1)) AS n, unnest(regexp_extract_all(text, {_NUMBER_UNIT}, 2)) AS w, generate_subscripts(regexp_extract_all(text, {_NUMBER_UNIT}), 1) AS i FROM sides)
), g AS (SELECT doc_id, side, number, list(unit) AS units, arg_min(word, i) AS word FROM u WHERE unit IS NOT NULL GROUP BY doc_id, side, number)
SELECT b.doc_id, b.number, b.word AS was, a.word AS now FROM g b JOIN g a ON a.doc_id = b.doc_id AND a.number = b.number AND b.side = 'before' AND a.side = 'after' WHERE NOT list_has_any(a.units, b.units)"""
ORACLE_SQL = {
    "v_swaps": _SWAPS,
    "v_negation": f"WITH {_TOKENS}, negated AS (SELECT * FROM tokens WHERE previous IN {_list(E.NEGATIONS)} AND w NOT IN {_list(E.NEGATIONS)}), plain AS (SELECT DISTINCT doc_id, side, w FROM tokens WHERE (previous IS NULL OR previous NOT IN {_list(E.NEGATIONS)}) AND w NOT IN {_list(E.NEGATIONS)}) {_FLIPS('gained', 'after', 'before')} UNION ALL {_FLIPS('lost', 'before', 'after')}",
    "v_roles": _ROLES,
    "v_unit_changes": _UNITS,
}
