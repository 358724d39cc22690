"""The registered queries, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, style
from ..sources import tables as S

WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-’''][\p{L}\p{N}]+)*')"
SENTENCES = rf"list_filter(string_split(regexp_replace(text, '([.!?…]+)\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: len({WORDS.replace('text,', 's,')}) > 0)"
HALF_UP = lambda x, d: f"(floor(({x}) * {10**d} + 0.5) / {10**d})"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents")


def _found() -> Column:
    """The findings of a text, as an array of kind, text and weight."""
    long = F.filter(T.words(F.col("text")), lambda x: F.length(x) >= 5)
    kind = lambda x: F.when(F.lower(x).rlike("ing$|ung$"), "process").when(F.lower(x).rlike("tion$|ción$"), "abstract")
    found = F.transform(long, lambda x: F.struct(kind(x).alias("kind"), x.alias("text"), F.when(kind(x) == "process", 1.5).otherwise(0.5).alias("weight")))
    return F.filter(found, lambda x: x["kind"].isNotNull())


def scores(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """doc_id, columns to keep, positive and the score of the text, 0 to 1, of all labelled documents."""
    labels = S.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    rows = style.scored(labels.join(_documents(spark, sf_dir), "doc_id"), _found(), "positive", *keep)
    return rows.withColumn("score", F.col("score") / 100).drop("label")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters or more that end in one of two ways, as findings with weights."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("place", "text"))
    kind = F.when(F.lower("text").rlike("ing$|ung$"), "process").when(F.lower("text").rlike("tion$|ción$"), "abstract")
    return rows.where(F.length("text") >= 5).withColumn("kind", kind).where("kind is not null").withColumn("weight", F.when(F.col("kind") == "process", 1.5).otherwise(0.5))


FINDINGS_SQL = rf"""SELECT doc_id, place, text, kind, CASE kind WHEN 'process' THEN 1.5 ELSE 0.5 END AS weight FROM (
  SELECT doc_id, place, w[place + 1] AS text, CASE WHEN regexp_matches(lower(w[place + 1]), 'ing$|ung$') THEN 'process' WHEN regexp_matches(lower(w[place + 1]), 'tion$|ción$') THEN 'abstract' END AS kind
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS place FROM (SELECT doc_id, {WORDS} AS w FROM documents))) WHERE kind IS NOT NULL AND length(text) >= 5"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "n_chars").withColumn("run", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return docs.select("doc_id", "run", F.pmod(F.floor(F.col("n_chars") / (F.col("run") + 1)), F.lit(4)).alias("level"))


def word_tokens(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return rows.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def lang_filter(spark, sf_dir):
    return _documents(spark, sf_dir).where("lang = 'de'").select("doc_id", "source", "n_chars")


def systematic_sample(spark, sf_dir):
    return evaluation.every_nth(_documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", F.lit(7))


def split_marked(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return rows.select("doc_id", F.posexplode(S.marked_pieces(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


def heatmap_red(spark, sf_dir):
    """A heat map of each text's sentences, each with the words beyond whole fives as its level; its red pieces."""
    item = lambda s: F.struct(F.pmod(F.size(T.words(s)), F.lit(5)).alias("level"), s.alias("text"), F.array(F.lit(1)).alias("pages"))
    raw = _documents(spark, sf_dir).select("doc_id", F.to_json(F.transform(T.sentences(F.col("text")), item)).alias("raw"))
    return raw.select("doc_id", F.explode(S.red_pieces(F.col("raw"))).alias("piece"))


def jsonl_validate(spark, sf_dir):
    parsed = S.parsed(F.col("props"))
    return S.table(spark, sf_dir, "events").select("event_id", parsed.isNotNull().alias("valid"), F.size(F.map_keys(parsed)).cast("long").alias("n_keys"))


def letter_share(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", T.letters(text, "Latin").cast("long").alias("latin"), T.letters(text, "Cyrillic").cast("long").alias("cyrillic"))


def normalize_yo(spark, sf_dir):
    """Whole texts behind words of our own in plain letters and hyphens: their hash, and how many words changed."""
    rows = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Ёлка‑ёж, ещё и кое‐что. "), F.col("text")).alias("t"))
    changed = F.size(F.filter(T.words(F.col("t")), lambda w: T.plain_yo(w) != w))
    return rows.select("doc_id", F.sha2(T.plain_yo(F.col("t")).cast("binary"), 256).alias("plain_sha256"), changed.cast("long").alias("n_changed"))


def norm_paragraph(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.length(T.collapsed(F.col("text"))).cast("long").alias("n_chars"), T.piece_fingerprint(F.col("text")).alias("fingerprint"))


def doc_fingerprint(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(T.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def plural_forms(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.plural(F.col("n_chars"), "знак", "знака", "знаков").alias("form"))


def sentences(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", F.size(T.words(F.col("sentence"))).cast("long").alias("n_words"))


def token_windows(spark, sf_dir):
    w = T.words(F.col("text"))
    rows = _documents(spark, sf_dir).select("doc_id", w.alias("w")).where("size(w) > 0")
    return rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(100))).alias("start")).select("doc_id", F.col("start").cast("long").alias("start"), F.array_join(F.slice("w", F.col("start") + 1, 100), " ").alias("tokens"))


def sentence_cv(spark, sf_dir):
    return style.sentence_spread(_documents(spark, sf_dir))


def mattr(spark, sf_dir):
    return style.diversity(_documents(spark, sf_dir))


def staccato(spark, sf_dir):
    return style.staccato(_documents(spark, sf_dir), least=2)


def same_opener(spark, sf_dir):
    return style.same_opener(_documents(spark, sf_dir), least=2)


def issues_distinct(spark, sf_dir):
    rows = _findings(spark, sf_dir).withColumn("place", F.floor(F.col("place") / 10))
    return style.longest_of_equal(rows).select("doc_id", "kind", "place", "text")


def doc_score(spark, sf_dir):
    return style.scored(_documents(spark, sf_dir), _found())


def fail_above(spark, sf_dir):
    return doc_score(spark, sf_dir).agg(F.coalesce(F.bool_or(F.col("score") > 90), F.lit(False)).alias("fails"), F.max("score").alias("highest"))


def fragment_probability(spark, sf_dir):
    """The probability of a text by the mean and the spread of its sentences' lengths."""
    spread = style.sentence_spread(_documents(spark, sf_dir))
    z = F.lit(-1.25) + 2.0 * (1 - F.coalesce("cv", F.lit(1.0))) + 0.05 * F.coalesce("mean_words", F.lit(0.0))
    p = T.rounded(T.sigmoid(z), 6)
    return spread.select("doc_id", p.alias("probability"), F.when(p >= 0.5, "red").when(p >= 0.4, "yellow").otherwise("green").alias("zone"))


def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(scores(spark, sf_dir))


def reliability(spark, sf_dir):
    return evaluation.reliability(scores(spark, sf_dir))


def threshold_grid(spark, sf_dir):
    return evaluation.threshold_grid(scores(spark, sf_dir))


def judge_agreement(spark, sf_dir):
    return evaluation.agreement(_answers(spark, sf_dir))


def judge_mean(spark, sf_dir):
    per = _answers(spark, sf_dir).groupBy("doc_id").agg(F.sum("level").alias("s"), F.count("level").alias("n"))
    mean = F.col("s") / F.col("n")
    return per.select("doc_id", T.rounded(mean, 4).alias("mean_level"), (mean >= 1.5).alias("suspect"))


def v_numbers(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))).alias("x"))
    before = rows.select("doc_id", F.translate("x", ",", ".").alias("number"))
    after = before.where("pmod(doc_id, 3) != 0").union(before.where("pmod(doc_id, 5) = 0"))
    return evaluation.bag_difference(before, after, ["doc_id", "number"])


QUERIES = {f.__name__: f for f in (sentence_cv, word_tokens, lang_filter, systematic_sample, split_marked, heatmap_red, jsonl_validate, letter_share, normalize_yo, norm_paragraph, doc_fingerprint, plural_forms, sentences, token_windows, mattr, staccato, same_opener, issues_distinct, doc_score, fail_above, fragment_probability, roc_auc, reliability, threshold_grid, judge_agreement, judge_mean, v_numbers)}

_SIZES = f"list_transform({SENTENCES}, lambda q: len({WORDS.replace('text,', 'q,')}))"
_ROWS = f"SELECT doc_id, s, unnest(range(len(s))) AS pos FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)"
_SCORE = rf"""SELECT doc_id, CAST(floor(100 * (1 - exp(-coalesce(raw, 0) / (8 * greatest(1.0, log2(greatest(n_words, 1) / 50))))) + 0.5) AS BIGINT) AS score FROM (SELECT doc_id, len({WORDS}) AS n_words FROM documents)
  LEFT JOIN (SELECT doc_id, sum(weight) AS raw FROM (SELECT doc_id, kind, lower(text) AS t, max(CAST(weight AS DOUBLE)) AS weight FROM ({FINDINGS_SQL}) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)"""
#: the score in hundredths of all labelled documents
SCORED_SQL = f"SELECT doc_id, s.score AS hundredths, quality = 1 AS positive, lang, source, n_chars, text FROM ({_SCORE}) s JOIN labels USING (doc_id) JOIN documents USING (doc_id)"
SCORES_SQL = f"SELECT doc_id, hundredths / 100 AS score, positive, lang FROM ({SCORED_SQL})"
_ANSWERS = "SELECT doc_id, run, CAST(floor(n_chars / (run + 1)) AS BIGINT) % 4 AS level FROM documents, unnest([1, 2, 3]) AS r(run)"
_P = HALF_UP("1 / (1 + exp(-z))", 6)
_PLAIN = lambda x: f"translate({x}, '‐‑ёЁ', '--еЕ')"
_SPREAD = f"""SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CASE WHEN n > 0 THEN {HALF_UP("t / n", 4)} END AS mean_words,
      CASE WHEN n > 1 AND t > 0 THEN {HALF_UP("sqrt(greatest(0.0, (q - t * t / n) / (n - 1))) / (t / n)", 4)} END AS cv
      FROM (SELECT doc_id, len(z) AS n, CAST(coalesce(list_sum(z), 0) AS DOUBLE) AS t, CAST(coalesce(list_sum(list_transform(z, lambda x: x * x)), 0) AS DOUBLE) AS q FROM (SELECT doc_id, {_SIZES} AS z FROM documents))"""
ORACLE_SQL = {
    "sentence_cv": _SPREAD,
    "word_tokens": f"SELECT lower(w) AS word, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) GROUP BY 1",
    "lang_filter": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de'",
    "systematic_sample": "SELECT doc_id, lang FROM documents WHERE doc_id % 7 = 6",
    "split_marked": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS pos, piece FROM (SELECT doc_id, k, trim(p[k]) AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE piece <> ''",
    "heatmap_red": f"SELECT doc_id, s AS piece FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents) WHERE len({WORDS.replace('text,', 's,')}) % 5 >= 3",
    "jsonl_validate": "SELECT event_id, json_valid(props) AS valid, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events",
    "letter_share": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Latin}')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '\p{Cyrillic}')) AS BIGINT) AS cyrillic FROM documents",
    "normalize_yo": f"SELECT doc_id, sha256({_PLAIN('t')}) AS plain_sha256, CAST(len(list_filter({WORDS.replace('text,', 't,')}, lambda w: {_PLAIN('w')} <> w)) AS BIGINT) AS n_changed FROM (SELECT doc_id, 'Ёлка‑ёж, ещё и кое‐что. ' || text AS t FROM documents)",
    "norm_paragraph": r"SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, left(sha256(c), 16) AS fingerprint FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)",
    "doc_fingerprint": r"SELECT left(sha256(trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'))), 16) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "plural_forms": "SELECT doc_id, CASE WHEN n_chars % 100 BETWEEN 11 AND 14 THEN 'знаков' WHEN n_chars % 10 = 1 THEN 'знак' WHEN n_chars % 10 BETWEEN 2 AND 4 THEN 'знака' ELSE 'знаков' END AS form FROM documents",
    "sentences": f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, s[pos + 1] AS sentence, CAST(len({WORDS.replace('text,', 's[pos + 1],')}) AS BIGINT) AS n_words FROM ({_ROWS})",
    "token_windows": f"SELECT doc_id, CAST(start AS BIGINT) AS start, array_to_string(w[start + 1 : start + 100], ' ') AS tokens FROM (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS start FROM (SELECT doc_id, {WORDS} AS w FROM documents))",
    "mattr": f"""WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda x: lower(x)) AS w FROM documents)
      SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, {HALF_UP("u / (50 * (len(w) - 49))", 6)} AS mattr FROM w LEFT JOIN (
      SELECT doc_id, sum(len(list_distinct(w[k : k + 49]))) AS u FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w) GROUP BY doc_id) USING (doc_id)""",
    "staccato": f"""SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (
      SELECT doc_id, pos, s[pos + 1] AS q FROM ({_ROWS})) WHERE len({WORDS.replace('text,', 'q,')}) <= 4 AND NOT regexp_matches(q, '[?:]$')) GROUP BY doc_id, g HAVING count(*) >= 2""",
    "same_opener": f"""SELECT doc_id, opener, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n FROM (SELECT doc_id, opener, pos, pos - row_number() OVER (PARTITION BY doc_id, opener ORDER BY pos) AS g FROM (
      SELECT doc_id, pos, lower({WORDS.replace('text,', 's[pos + 1],')}[1]) AS opener FROM ({_ROWS})) WHERE length(opener) > 1) GROUP BY doc_id, opener, g HAVING count(*) >= 2""",
    "issues_distinct": f"SELECT doc_id, kind, place, text FROM (SELECT doc_id, kind, CAST(floor(place / 10) AS BIGINT) AS place, text FROM ({FINDINGS_SQL})) QUALIFY row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY length(text) DESC, text) = 1",
    "doc_score": f"SELECT doc_id, score, CASE WHEN score < 15 THEN 'clean' WHEN score < 40 THEN 'light' WHEN score < 70 THEN 'marked' ELSE 'heavy' END AS label FROM ({_SCORE})",
    "fail_above": f"SELECT coalesce(bool_or(score > 90), false) AS fails, max(score) AS highest FROM ({_SCORE})",
    "fragment_probability": f"SELECT doc_id, p AS probability, CASE WHEN p >= 0.5 THEN 'red' WHEN p >= 0.4 THEN 'yellow' ELSE 'green' END AS zone FROM (SELECT doc_id, {_P} AS p FROM (SELECT doc_id, CAST(-1.25 AS DOUBLE) + CAST(2.0 AS DOUBLE) * (1 - coalesce(cv, CAST(1.0 AS DOUBLE))) + CAST(0.05 AS DOUBLE) * coalesce(mean_words, CAST(0.0 AS DOUBLE)) AS z FROM ({_SPREAD})))",
    "roc_auc": f"""WITH s AS ({SCORES_SQL}), c AS (SELECT count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM s)
      SELECT {HALF_UP("w / (2.0 * p * n)", 6)} AS auc, p AS n_positive, n AS n_negative FROM c, (SELECT CAST(sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END) AS DOUBLE) AS w FROM s a, s b WHERE a.positive AND NOT b.positive)""",
    "reliability": f"SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, {HALF_UP('CAST(sum(floor(score * 1000 + 0.5)) AS DOUBLE) / count(*) / 1000', 6)} AS mean_score, {HALF_UP('count(*) FILTER (positive) / count(*)', 6)} AS share_positive FROM ({SCORES_SQL}) GROUP BY 1",
    "threshold_grid": f"SELECT t AS threshold, {HALF_UP('(count(*) FILTER (positive AND floor(score * 1000 + 0.5) >= t * 10) / count(*) FILTER (positive) + count(*) FILTER (NOT positive AND floor(score * 1000 + 0.5) < t * 10) / count(*) FILTER (NOT positive)) / 2', 6)} AS balanced_accuracy FROM ({SCORES_SQL}), range(20, 81, 2) AS g(t) GROUP BY t",
    "judge_agreement": f"WITH a AS ({_ANSWERS}) SELECT CAST(a.run AS BIGINT) AS run_a, CAST(b.run AS BIGINT) AS run_b, count(*) AS n, {HALF_UP('count(*) FILTER (a.level = b.level) / count(*)', 6)} AS agreement FROM a JOIN a b ON a.doc_id = b.doc_id AND a.run < b.run GROUP BY 1, 2",
    "judge_mean": f"SELECT doc_id, {HALF_UP('CAST(sum(level) AS DOUBLE) / count(*)', 4)} AS mean_level, sum(level) / count(*) >= 1.5 AS suspect FROM ({_ANSWERS}) GROUP BY doc_id",
    "v_numbers": r"""WITH b AS (SELECT doc_id, replace(x, ',', '.') AS number FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS x FROM documents)),
      a AS (SELECT * FROM b WHERE doc_id % 3 <> 0 UNION ALL SELECT * FROM b WHERE doc_id % 5 = 0)
      SELECT doc_id, number, 'missing' AS side, count(*) AS surplus FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL
      UNION ALL SELECT doc_id, number, 'added', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL""",
}
