"""Queries of the rule operators on documents with a marked-up passage of our own before each text, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..operators import evaluation, rules
from ..operators.rows import once
from ..operators.rules import Rule
from ..sources import tables as S
from .queries import SCORED_SQL, scores

PASSAGES = (
    "---\ntitle: Отчёт\n---\n# Итоги года\n\nВажно отметить, что рынок играет ключевую роль. Стоит подчеркнуть рост на 3.5 процента.\n\n- первый пункт\n- второй пункт\n",
    "Код `x = 1` и ещё код:\n```\nважно отметить\n```\nСсылка https://example.org/a?utm_source=chat дальше.\n",
    "## План\n\n1. Начать\n2. Кончить\n\n> Слова другого\n\n#рост #рынок #итог\n",
    "Невидимое​ слово и мяг­кий знак, ещё​ одно → дальше.\n[вставить имя] и 20XX год.\n",
    "Он сказал: \"да\" - и ушёл. Таким образом, важно отметить итог.\n\n| a | b |\n| 1 | 2 |\n",
    "Обычный абзац без примет. Рост составил 2.25 пункта. `код` в строке.\n",
)
CODE = "```[^`]*```|`[^`\n]+`"
URL = r"https?://[^\s)]+"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
RULES = [
    Rule("note", "opener", "P1", "(?iu)важно отметить"),
    Rule("stress", "opener", "P1", "(?iu)стоит подчеркнуть"),
    Rule("role", "template", "P1", "(?iu)играет ключевую роль"),
    Rule("thus", "transition", "P2", "(?iu)таким образом,"),
    Rule("placeholder", "placeholder", "P0", r"\[вставить [^\]\n]*\]|20XX"),
    Rule("chat-link", "ai-url", "P0", r"https?://[^\s)]*utm_source=chat[^\s)]*"),
    Rule("hashtag", "hashtag", "P2", r"#[\p{L}\p{N}_]+"),
    Rule("straight-quotes", "typography", "P2", "\"[^\"\n]*\\p{IsCyrillic}[^\"\n]*\""),
    Rule("hyphen-dash", "typography", "P2", r"[\p{L}\p{N}\"] - "),
    Rule("decimal-point", "typography", "P2", r"[0-9]+\.[0-9]+ (?:процент|пункт)\p{L}*"),
    Rule("hidden", "invisible", "P0", "[​‎⁠]"),
    Rule("soft-hyphen", "soft-hyphen", "P1", "­"),
    Rule("rare-sign", "typographic", "P2", "[→←•]"),
]
RED, YELLOW = ["invisible", "placeholder", "ai-url"], ["opener", "template", "soft-hyphen"]
SHIFTS = [*range(-800, 801, 20)]


def _marked(spark, sf_dir) -> DataFrame:
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int") + 1)
    return S.table(spark, sf_dir, "documents").select("doc_id", F.concat(passage, F.col("text")).alias("text"))


def _findings(spark, sf_dir) -> DataFrame:
    return rules.findings(_marked(spark, sf_dir), RULES)


def _edited(spark, sf_dir) -> DataFrame:
    """before, and after an edit: links cut, a number changed, a heading lowered, by doc_id."""
    k, text = F.pmod("doc_id", F.lit(5)), F.col("text")
    after = F.when(k == 0, F.regexp_replace(text, URL, "")).when(k == 1, F.replace(text, F.lit("1"), F.lit("7"))).when(k == 2, F.regexp_replace(text, "# ", "## ")).otherwise(text)
    return _marked(spark, sf_dir).select("doc_id", text.alias("before"), after.alias("after"))


def _bags(spark, sf_dir, pattern: str, name: str) -> DataFrame:
    found = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return evaluation.bag_changes(_edited(spark, sf_dir), found("before"), found("after"), name, "doc_id")


def issues(spark, sf_dir):
    return _findings(spark, sf_dir)


def lexicon_hits(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("rule", "kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def issues_min_severity(spark, sf_dir):
    return rules.at_least(_findings(spark, sf_dir), "P1").select("doc_id", "rule", "severity", "start")


def tier2_cluster(spark, sf_dir):
    return rules.clusters(_findings(spark, sf_dir), "opener", 2)


def hashtags(spark, sf_dir):
    per = _findings(spark, sf_dir).where("rule = 'hashtag'").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))
    return per.where("n >= 3")


def traffic_light(spark, sf_dir):
    return rules.lights(_marked(spark, sf_dir), RULES, RED, YELLOW)


def mask_code(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", spans.blanked(F.col("text"), CODE).alias("masked"))


def visible_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[​‎⁠­]", "").alias("visible"))


def blocks(spark, sf_dir):
    return rules.sections(_marked(spark, sf_dir))


def punctuation_rates(spark, sf_dir):
    text = F.col("text")
    n = F.size(T.words(text))
    rate = lambda p: T.rounded(F.regexp_count(text, F.lit(p)) * 1000 / n, 4)
    return S.table(spark, sf_dir, "documents").where(n > 0).select("doc_id", rate(",").alias("comma"), rate("[;:]").alias("colon"), rate("[!?]").alias("loud"), rate("—").alias("dash"))


def v_urls(spark, sf_dir):
    return _bags(spark, sf_dir, URL, "url")


def v_code(spark, sf_dir):
    return _bags(spark, sf_dir, CODE, "code")


def v_headings(spark, sf_dir):
    """Skeletons of headings, where an edit changed them."""
    shape = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("(?:^|\n)(#{1,6}) "), F.lit(1)), " ").alias(c)
    return _edited(spark, sf_dir).select("doc_id", shape("before"), shape("after")).where("before != after")


def v_yaml(spark, sf_dir):
    """Whether an edit left the header of a text as it was."""
    header = lambda c: F.regexp_extract(c, "^---\n(?:[^\n]*\n)*?---\n", 0)
    return _edited(spark, sf_dir).select("doc_id", header("before").eqNullSafe(header("after")).alias("same"), (header("before") != "").alias("has_header"))


def v_issue_growth(spark, sf_dir):
    """Texts with findings before or after the edit, and whether they are more after it."""
    n = lambda c: rules.n_findings(F.col(c), RULES)
    both = once(_edited(spark, sf_dir), n_before=n("before"), n_after=n("after")).where("n_before + n_after > 0")
    return both.select("doc_id", "n_before", "n_after", (F.col("n_after") > F.col("n_before")).alias("grown"))


def bias_shift_grid(spark, sf_dir):
    rows = scores(spark, sf_dir, "lang").select(F.col("lang").alias("grp"), F.round(F.col("score") * 1000).cast("long").alias("score"), "positive")
    return rules.shift_errors(rows, SHIFTS, 500)


QUERIES = {f.__name__: f for f in (issues, lexicon_hits, issues_min_severity, tier2_cluster, hashtags, traffic_light, mask_code, visible_text, blocks, punctuation_rates, v_urls, v_code, v_headings, v_yaml, v_issue_growth, bias_shift_grid)}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    return _lit(pattern.replace("(?iu)", "(?i)").replace("{Is", "{"))


MARKED_SQL = f"SELECT doc_id, [{', '.join(map(_lit, PASSAGES))}][doc_id % {len(PASSAGES)} + 1] || text AS text FROM documents"
EDITED_SQL = f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN regexp_replace(text, {_re(URL)}, '', 'g') WHEN 1 THEN replace(text, '1', '7') WHEN 2 THEN replace(text, '# ', '## ') ELSE text END AS text FROM ({MARKED_SQL})"


def findings_sql(source: str, some: list[Rule] = RULES) -> str:
    cut = " UNION ALL ".join(f"SELECT doc_id, text AS t, {_lit(r.name)} AS rule, {_lit(r.kind)} AS kind, {_lit(r.severity)} AS severity, string_split_regex(text, {_re(r.pattern)}) AS gaps, regexp_extract_all(text, {_re(r.pattern)}) AS hits FROM m" for r in some)
    return f"""WITH m AS ({source}), c AS ({cut}), e AS (SELECT doc_id, t, rule, kind, severity, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM c),
      p AS (SELECT doc_id, t, rule, kind, severity, hits[i] AS hit, CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS BIGINT) AS start FROM e)
      SELECT doc_id, rule, kind, severity, start, CAST(length(regexp_replace(left(t, start), '[^\\n]', '', 'g')) + 1 AS BIGINT) AS line, CAST(length(regexp_extract(left(t, start), '[^\\n]*$')) + 1 AS BIGINT) AS col, left(hit, 160) AS text FROM p"""


_FOUND, _AFTER = findings_sql(MARKED_SQL), findings_sql(EDITED_SQL)
_IN = lambda names: ", ".join(map(_lit, names))
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(s, {_lit(p)}) THEN {_lit(k)}" for k, p in rules.LINES.items()) + " ELSE 'prose' END"


def _bags_sql(pattern: str, name: str) -> str:
    each = lambda source: f"SELECT doc_id, unnest(regexp_extract_all(text, {_re(pattern)})) AS {name} FROM ({source})"
    side = lambda a, b, label: f"SELECT doc_id, {name}, '{label}' AS side, count(*) AS surplus FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) GROUP BY ALL"
    return f"WITH b AS ({each(MARKED_SQL)}), a AS ({each(EDITED_SQL)}) {side('b', 'a', 'missing')} UNION ALL {side('a', 'b', 'added')}"


def _rate_sql(pattern: str) -> str:
    return f"floor(len(regexp_extract_all(text, {_lit(pattern)})) * 1000 / n * 10000 + 0.5) / 10000"


_SHAPE = "array_to_string(regexp_extract_all(text, '(?:^|\n)(#{1,6}) ', 1), ' ')"
_HEADER = "regexp_extract(text, '^---\n(?:[^\n]*\n)*?---\n')"
_PAIR = lambda x: f"(SELECT doc_id, {x} AS before FROM ({MARKED_SQL})) JOIN (SELECT doc_id, {x} AS after FROM ({EDITED_SQL})) USING (doc_id)"
ORACLE_SQL = {
    "issues": _FOUND,
    "lexicon_hits": f"SELECT rule, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_FOUND}) GROUP BY ALL",
    "issues_min_severity": f"SELECT doc_id, rule, severity, start FROM ({_FOUND}) WHERE severity <= 'P1'",
    "tier2_cluster": f"SELECT doc_id, count(DISTINCT rule) AS n_rules, min(start) AS first_start FROM ({_FOUND}) WHERE kind = 'opener' GROUP BY doc_id HAVING count(DISTINCT rule) >= 2",
    "hashtags": f"SELECT doc_id, count(*) AS n, min(start) AS first_start FROM ({_FOUND}) WHERE rule = 'hashtag' GROUP BY doc_id HAVING count(*) >= 3",
    "traffic_light": f"SELECT doc_id, CASE WHEN count(*) FILTER (kind IN ({_IN(RED)})) > 0 THEN 'red' WHEN count(*) FILTER (kind IN ({_IN(YELLOW)})) > 0 THEN 'yellow' ELSE 'green' END AS light, count(kind) AS n_findings FROM documents LEFT JOIN (SELECT doc_id, kind FROM ({_FOUND})) USING (doc_id) GROUP BY doc_id",
    "mask_code": f"SELECT doc_id, array_to_string(list_transform(g, lambda x, i: x || coalesce(regexp_replace(h[i], '[^\\n]', ' ', 'g'), '')), '') AS masked FROM (SELECT doc_id, string_split_regex(text, {_re(CODE)}) AS g, regexp_extract_all(text, {_re(CODE)}) AS h FROM ({MARKED_SQL}))",
    "visible_text": f"SELECT doc_id, replace(replace(replace(replace(text, chr(8203), ''), chr(8206), ''), chr(8288), ''), chr(173), '') AS visible FROM ({MARKED_SQL})",
    "blocks": f"""WITH l AS (SELECT doc_id, pos, s, {_KIND} AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ({MARKED_SQL}))),
      g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS island FROM l)
      SELECT doc_id, kind, CAST(min(pos) AS BIGINT) AS first_line, count(*) AS n_lines, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM g WHERE kind <> 'empty' GROUP BY doc_id, kind, island""",
    "punctuation_rates": rf"SELECT doc_id, {_rate_sql(',')} AS comma, {_rate_sql('[;:]')} AS colon, {_rate_sql('[!?]')} AS loud, {_rate_sql('—')} AS dash FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[-’''][\p{{L}}\p{{N}}]+)*')) AS n FROM documents) WHERE n > 0",
    "v_urls": _bags_sql(URL, "url"),
    "v_code": _bags_sql(CODE, "code"),
    "v_headings": f"SELECT doc_id, before, after FROM {_PAIR(_SHAPE)} WHERE before <> after",
    "v_yaml": f"SELECT doc_id, before = after AS same, before <> '' AS has_header FROM {_PAIR(_HEADER)}",
    "v_issue_growth": f"SELECT doc_id, coalesce(x, 0) AS n_before, coalesce(y, 0) AS n_after, coalesce(y, 0) > coalesce(x, 0) AS grown FROM (SELECT doc_id, count(*) AS x FROM ({_FOUND}) GROUP BY doc_id) FULL JOIN (SELECT doc_id, count(*) AS y FROM ({_AFTER}) GROUP BY doc_id) USING (doc_id)",
    "bias_shift_grid": f"""SELECT shift, CAST(sum(e) AS BIGINT) AS error, count(*) AS n_groups FROM (SELECT shift, lang, CAST(floor(abs(count(*) FILTER (hundredths * 10 + shift >= 500) - count(*) FILTER (positive)) * 1000000 / count(*)) AS BIGINT) AS e
      FROM ({SCORED_SQL}), (SELECT unnest(range(-800, 801, 20)) AS shift) GROUP BY shift, lang) GROUP BY shift""",
}
