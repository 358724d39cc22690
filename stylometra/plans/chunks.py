"""Queries of sentences, of overlapping chunks and their scores, of signals, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sentences as N
from ..functions import text as T
from ..operators import chunks as C
from ..operators import dictionary as D
from ..operators import fragments
from ..operators.fragments import BIAS, LIMIT, NAMES, WEIGHTS
from ..sources import tables as S
from . import dictionaries
from .queries import HALF_UP, WORDS
from .rules import _lit

PASSAGES = (
    "В 1999 г. Иванов И. И. переехал в г. Москву. Он спросил: «Куда?» Ответа не было... Затем, т. е. позже, см. рис. 5, всё стало ясно!",
    "# Заголовок\n- первый пункт\n- второй пункт. Третий\n1. Раз\n> цитата\n\nСтрана — США. Это один, два, три, четыре, пять, шесть, семь, восемь, девять, десять, одиннадцать, двенадцать, тринадцать, четырнадцать слов подряд.",
    "Fig. 3 shows it, i.e. vol. 2, pp. 7 etc. And so on. 25 млн. руб. 30 коп. Итого. — Да? — Нет! (Может быть.) И т. д. Конец",
    "Короткая строка",
)
# A window of our own: small, so that every text has several chunks, and a cap below the length of some sentences.
WIDTH, CAP, KEEP = 60, round(60 * C.UNIT), round(60 * C.OVERLAP)
READ_WORDS, READ_CHARS = 150, 1200
#: a second model for the agreement: other weights of the same features
OTHER_BIAS, OTHER_WEIGHTS = -3.0, (0.6, 1.9, 1.1, 0.2, 0.9, 1.0, 1.2)
SIGNALS, CLERICAL = "важно|кроме того|однако", "повышение|реализации|деятельности"


def _texts(spark, sf_dir) -> DataFrame:
    """The whole texts behind passages of our own, as they have no abbreviations, lists and Cyrillic sentences."""
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int") + 1)
    return S.table(spark, sf_dir, "documents").select("doc_id", F.concat(passage, F.lit("\n\n"), F.col("text")).alias("text"))


def _chunks(spark, sf_dir) -> DataFrame:
    return C.chunks(_texts(spark, sf_dir), WIDTH)


def _rated(rows: DataFrame, *keys: str) -> DataFrame:
    """Pieces with their features."""
    text = F.col("text")
    return fragments.features(fragments.measured(rows, dictionaries.RARE, D.count(text, SIGNALS), D.count(text, CLERICAL)), *keys)


def _probability(bias: float, weights: tuple):
    return T.rounded(T.sigmoid(F.lit(bias) + sum((w * F.col(x) for w, x in zip(weights, NAMES)), F.lit(0.0))), 6)


def sentence_rows(spark, sf_dir):
    """Every sentence of every text, with abbreviations, initials and closing quotes respected."""
    rows = _texts(spark, sf_dir).select("doc_id", F.posexplode(N.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(T.words(F.col("sentence"))).cast("long").alias("n_words"), "sentence")


def chunk_spans(spark, sf_dir):
    """Overlapping chunks of whole sentences of every text."""
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "start", "end", "line", "end_line", "n_words", "word_start")


def chunk_scan(spark, sf_dir):
    """Scores of all chunks in Latin script, by text: counts, the share of words above the threshold, its lines."""
    keys = ["doc_id", "chunk", "line", "end_line", "n_words", "word_start", "text_words", "_read"]
    rows = _rated(_chunks(spark, sf_dir).withColumn("_read", C.readable(F.col("text"), "Latin")), *keys)
    rated = rows.withColumn("probability", F.when(F.col("_read"), _probability(BIAS, WEIGHTS)))
    out = C.scanned(rated, ["doc_id"], LIMIT)
    lines = F.array_join(F.transform("lines", lambda x: F.concat_ws("-", x["first"], x["last"])), ",")
    return out.select("doc_id", "n_chunks", "n_skipped", "n_above", "share", lines.alias("lines"))


def read_coverage(spark, sf_dir):
    """How far a model reads that takes 150 words and 1200 characters."""
    return C.coverage(_texts(spark, sf_dir), READ_WORDS, READ_CHARS).drop("text")


def model_agree(spark, sf_dir):
    """Signals of two models of fragments' features on whole texts, and whether they agree."""
    texts = _texts(spark, sf_dir).withColumn("_read", C.readable(F.col("text"), "Latin"))
    signals = F.array(C.signal(_probability(BIAS, WEIGHTS), LIMIT, F.col("_read")), C.signal(_probability(OTHER_BIAS, OTHER_WEIGHTS), LIMIT, F.col("_read")))
    rows = _rated(texts, "doc_id", "_read").select("doc_id", signals.alias("s"))
    rows = rows.select("doc_id", *(F.col("s")[k][n].alias(f"{n}_{k + 1}") for k in (0, 1) for n in ("probability", "near")), C.agreement(F.col("s")).alias("a"))
    return rows.select("*", "a.*").drop("a")


QUERIES = {f.__name__: f for f in (sentence_rows, chunk_spans, chunk_scan, read_coverage, model_agree)}

_W = lambda x: WORDS.replace("text,", f"{x},")
TEXTS_SQL = f"SELECT doc_id, [{', '.join(map(_lit, PASSAGES))}][doc_id % {len(PASSAGES)} + 1] || chr(10) || chr(10) || text AS text FROM documents"
_B = "\x1e"
# Borders behind all candidates, then those behind capitals and abbreviations taken away.
_BORDERED = "text"
for _from, _to in (
    (rf"\n({N.LINE})", rf"chr(10){_B}\1"), (rf"({N.MARKS})({N.BLANK}+(?:{N.OPENS}{N.BLANK}*)?[\p{{Lu}}0-9])", rf"\1{_B}\2"),
    (rf"(\p{{Lu}}{N.MARKS}){_B}", r"\1"), (rf"((?:^|[^\p{{L}}.])(?i:{N.SHORT}){N.MARKS}){_B}", r"\1"),
):
    _BORDERED = f"regexp_replace({_BORDERED}, {_lit(_from)}, {_lit(_to)}, 'g')".replace("'chr(10)", "chr(10) || '")
#: parts of each text with their places: a part is a sentence if it has a word
_PARTS = f"""SELECT doc_id, i, p, regexp_replace(p, '^{N.BLANK}+|{N.BLANK}+$', '', 'g') AS s, CAST(coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM (SELECT doc_id, i, parts[i] AS p FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split({_BORDERED}, '{_B}') AS parts FROM ({TEXTS_SQL}))))"""
_RUN = rf"{N.BLANK}*[^\s\p{{Z}}]+"
#: runs of signs of each sentence with places and words; halves of halves; the fold over the sums of words
_CHUNKS = f"""t AS MATERIALIZED ({TEXTS_SQL}), parts AS MATERIALIZED (SELECT * FROM ({_PARTS}) WHERE len({_W('s')}) > 0),
runs AS MATERIALIZED (
  SELECT doc_id, i, k, off + sum(length(r)) OVER w AS z, length(regexp_replace(r, '^{N.BLANK}+', '')) AS n, sum(len({_W('r')})) OVER w AS c
  FROM (SELECT doc_id, i, off, k, r[k] AS r FROM (SELECT doc_id, i, off, r, unnest(range(1, len(r) + 1)) AS k FROM (SELECT doc_id, i, off, regexp_extract_all(p, {_lit(_RUN)}) AS r FROM parts)))
  WINDOW w AS (PARTITION BY doc_id, i ORDER BY k)
), held AS MATERIALIZED (SELECT doc_id, i, list(c ORDER BY k) AS c, list(z - n ORDER BY k) AS a, list(z ORDER BY k) AS z FROM runs GROUP BY doc_id, i),
halved AS (
  SELECT doc_id, i, CAST(1 AS BIGINT) AS x, CAST(len(c) AS BIGINT) AS y FROM held
  UNION ALL
  SELECT doc_id, i, CASE WHEN o = 1 THEN x ELSE x + (y - x + 1) // 2 END, CASE WHEN o = 1 THEN x + (y - x + 1) // 2 - 1 ELSE y END
  FROM halved JOIN held USING (doc_id, i), (VALUES (1), (2)) v(o) WHERE y > x AND c[y] - coalesce(c[x - 1], 0) > {CAP}
), units AS (
  SELECT doc_id, a[x] AS a, z[y] AS z, c[y] - CASE WHEN x > 1 THEN c[x - 1] ELSE 0 END AS n FROM halved JOIN held USING (doc_id, i)
  WHERE NOT (y > x AND c[y] - CASE WHEN x > 1 THEN c[x - 1] ELSE 0 END > {CAP})
), sums AS MATERIALIZED (
  SELECT doc_id, list_prepend(0, list(s ORDER BY a)) AS p, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY a) AS BIGINT) AS s FROM units) GROUP BY doc_id
), fold AS (
  SELECT doc_id, 0 AS chunk, 0 AS i, least(len(a), greatest(1, len(list_filter(p, lambda x: x <= {WIDTH})) - 1)) AS j FROM sums
  UNION ALL
  SELECT doc_id, chunk + 1, i, greatest(i + 1, len(list_filter(p, lambda x: x <= p[i + 1] + {WIDTH})) - 1)
  FROM (SELECT doc_id, chunk, p, greatest(i + 1, least(j, len(list_filter(p, lambda x: x < p[j + 1] - {KEEP})))) AS i FROM fold JOIN sums USING (doc_id) WHERE j < len(a))
), chunks AS MATERIALIZED (
  SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(s.a[f + 1] AS BIGINT) AS start, CAST(s.z[j] AS BIGINT) AS z, CAST(p[j + 1] - p[f + 1] AS BIGINT) AS n_words, CAST(p[f + 1] AS BIGINT) AS word_start, CAST(p[-1] AS BIGINT) AS text_words, t.text AS whole
  FROM (SELECT doc_id, chunk, j, CASE WHEN j < len(s.a) THEN i ELSE greatest(coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY chunk) + 1, 0), least(i, len(list_filter(p, lambda x: x < p[j + 1] - {WIDTH})))) END AS f FROM fold JOIN sums s USING (doc_id))
  JOIN sums s USING (doc_id) JOIN t USING (doc_id)
)"""
_LINE = lambda x: f"CAST(length(whole[1:{x}]) - length(replace(whole[1:{x}], chr(10), '')) + 1 AS BIGINT)"
_ROWS = f"SELECT doc_id, chunk, start, z AS \"end\", {_LINE('start')} AS line, {_LINE('z')} AS end_line, n_words, word_start, text_words, whole[start + 1 : z] AS text FROM chunks"


def _featured(source: str) -> str:
    """The features of the pieces of a source of doc_id, fragment and text."""
    return dictionaries._FEATURED.replace(dictionaries._FRAGMENTS, f"({source})")


def _p(bias: float, weights: tuple) -> str:
    z = f"(CAST({bias} AS DOUBLE) + " + " + ".join(f"CAST({w} AS DOUBLE) * {x}" for w, x in zip(weights, NAMES)) + ")"
    return HALF_UP(f"1 / (1 + exp(-{z}))", 6)


def _read(x: str) -> str:
    own, other = (rf"len(regexp_extract_all({x}, '\p{{{s}}}'))" for s in ("Latin", "Cyrillic"))
    return f"({own} + {other} > 0 AND {own} >= {C.LEAST_SHARE} * ({own} + {other}))"


_FITS = f"w <= {READ_WORDS} AND c <= {READ_CHARS}"
_NEAR = lambda k: f"coalesce(abs(probability_{k} - {LIMIT}) < {C.NEAR}, false) AS near_{k}"
_ABOVE = lambda k: f"CASE WHEN probability_{k} >= {LIMIT} THEN 1 ELSE 0 END"
ORACLE_SQL = {
    "sentence_rows": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos, CAST(len({_W('s')}) AS BIGINT) AS n_words, s AS sentence FROM ({_PARTS}) WHERE len({_W('s')}) > 0",
    "chunk_spans": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk, start, \"end\", line, end_line, n_words, word_start FROM ({_ROWS})",
    # Words and lines are counted one by one: each that lies in a chunk above the threshold, once.
    "chunk_scan": f"""WITH RECURSIVE {_CHUNKS}, r AS MATERIALIZED ({_ROWS}), f AS MATERIALIZED ({_featured("SELECT doc_id, chunk AS fragment, text FROM r")}),
p AS MATERIALIZED (SELECT r.*, CASE WHEN {_read('text')} THEN {_p(BIAS, WEIGHTS)} END AS p FROM r JOIN f ON f.doc_id = r.doc_id AND f.fragment = r.chunk),
w AS (SELECT doc_id, w, bool_or(coalesce(p >= {LIMIT}, false)) AS hit, bool_and(p IS NULL) AS lost FROM (SELECT doc_id, p, unnest(range(word_start, word_start + n_words)) AS w FROM p) GROUP BY doc_id, w),
l AS (SELECT DISTINCT doc_id, unnest(range(line, end_line + 1)) AS l FROM p WHERE p >= {LIMIT}),
g AS (SELECT doc_id, min(l) AS a, max(l) AS z FROM (SELECT doc_id, l, l - row_number() OVER (PARTITION BY doc_id ORDER BY l) AS g FROM l) GROUP BY doc_id, g)
SELECT doc_id, n_chunks, n_skipped, n_above, CASE WHEN left_over > 0 THEN {HALF_UP('hit / left_over', 4)} ELSE 0.0 END AS share, coalesce(lines, '') AS lines
FROM (SELECT doc_id, count(*) AS n_chunks, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped, CAST(sum(CASE WHEN p >= {LIMIT} THEN 1 ELSE 0 END) AS BIGINT) AS n_above FROM p GROUP BY doc_id)
JOIN (SELECT doc_id, count(*) FILTER (hit) AS hit, count(*) FILTER (NOT lost) AS left_over FROM w GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(a || '-' || z, ',' ORDER BY a) AS lines FROM g GROUP BY doc_id) USING (doc_id)""",
    "read_coverage": f"""WITH t AS MATERIALIZED ({TEXTS_SQL}), r AS (SELECT doc_id, k, sum(length(r)) OVER w AS c, sum(len({_W('r')})) OVER w AS w FROM (SELECT doc_id, k, r[k] AS r FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, {_lit(_RUN)}) AS r FROM t))) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
e AS (SELECT doc_id, coalesce(max(c) FILTER ({_FITS}), 0) AS c, coalesce(max(w) FILTER ({_FITS}), 0) AS w, max(w) AS n, max(c) FILTER ({_FITS}) = max(c) AS entire FROM r GROUP BY doc_id),
x AS (SELECT doc_id, text, w, n, CASE WHEN entire AND length(text) <= {READ_CHARS} THEN length(text) ELSE c END AS c FROM t JOIN e USING (doc_id))
SELECT doc_id, CAST(c AS BIGINT) AS read_chars, length(text) AS n_chars, CAST(w AS BIGINT) AS read_words, CAST(n AS BIGINT) AS n_words, {_LINE('c').replace('whole', 'text')} AS read_lines, {_LINE('length(whole)').replace('whole', 'text')} AS n_lines FROM x""",
    "model_agree": f"""WITH t AS MATERIALIZED ({TEXTS_SQL}), f AS MATERIALIZED ({_featured("SELECT doc_id, 0 AS fragment, text FROM t")}),
p AS (SELECT doc_id, CASE WHEN read THEN {_p(BIAS, WEIGHTS)} END AS probability_1, CASE WHEN read THEN {_p(OTHER_BIAS, OTHER_WEIGHTS)} END AS probability_2 FROM f JOIN (SELECT doc_id, {_read('text')} AS read FROM t) USING (doc_id))
SELECT doc_id, probability_1, {_NEAR(1)}, probability_2, {_NEAR(2)}, CAST({_ABOVE(1)} + {_ABOVE(2)} AS BIGINT) AS n_above, CASE WHEN probability_1 IS NOT NULL THEN {_ABOVE(1)} = {_ABOVE(2)} END AS agree FROM p""",
}
