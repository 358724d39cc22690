"""Queries of evaluation, calibration and raters' answers on the documents' labels, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..sources import tables as S
from .queries import HALF_UP, SCORED_SQL, SENTENCES, WORDS, scores

# The score thresholds in hundredths, and the lengths in words at which buckets begin.
THRESHOLDS = [15, 40, 70]
LENGTHS = [0, 50, 150, 400]
FEATURES = {"chars": "n_chars", "breaks": "length(text) - length(replace(text, chr(10), ''))", "commas": "length(text) - length(replace(text, ',', ''))"}


def _scores(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir, "lang", "source", "n_chars", "text")


def metrics_at_threshold(spark, sf_dir):
    return E.metrics(E.confusions(_scores(spark, sf_dir), THRESHOLDS)).withColumnRenamed("t", "threshold")


def best_f1(spark, sf_dir):
    return E.best_f1(_scores(spark, sf_dir))


def class_report(spark, sf_dir):
    return E.class_report(E.confusions(_scores(spark, sf_dir), [50]))


def brier_logloss(spark, sf_dir):
    return E.brier_logloss(_scores(spark, sf_dir))


def reliability_ece(spark, sf_dir):
    return E.reliability_table(_scores(spark, sf_dir), 12)


def rates_by_group(spark, sf_dir):
    return E.rates_by_group(_scores(spark, sf_dir), "lang")


def balanced_accuracy(spark, sf_dir):
    return E.metrics(E.confusions(_scores(spark, sf_dir), [50], ("lang",)), ("lang",)).select("lang", "balanced_accuracy")


def genre_table(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    counts = E.confusions(rows, [40], ("source",))
    shares = counts.select("source", E.share(F.col("tp"), F.col("tp") + F.col("fn")).alias("high_positive"), E.share(F.col("fp"), F.col("fp") + F.col("tn")).alias("high_negative"))
    return shares.join(E.roc_auc(rows, ("source",)).select("source", "auc", "n_positive", "n_negative"), "source")


def length_buckets(spark, sf_dir):
    n = F.size(T.words(F.col("text")))
    bucket = F.lit(LENGTHS[0])
    for edge in LENGTHS[1:]:
        bucket = F.when(n >= edge, edge).otherwise(bucket)
    rows = _scores(spark, sf_dir).withColumn("bucket", bucket.cast("long"))
    return E.confusions(rows, [40], ("bucket",)).select("bucket", (F.col("tp") + F.col("fn")).alias("n"), E.share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def topk_generators(spark, sf_dir):
    per = _scores(spark, sf_dir).where("positive").groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("score") >= 0.4).cast("long")).alias("hit"))
    return per.orderBy(F.desc("n"), "source").limit(15).select("source", "n", E.share(F.col("hit"), F.col("n")).alias("recall"))


def shortcut_auc(spark, sf_dir):
    """AUC of single features of layout: what a model could learn instead of style."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.least(F.lit(0.999999), F.expr(v) / 1_000_000).alias("score")) for k, v in FEATURES.items()))).alias("f")
    rows = _scores(spark, sf_dir).select("positive", each).select("positive", "f.feature", "f.score")
    return E.roc_auc(rows, ("feature",))


def report_import(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("doc_key"), "source")
    old = docs.where("pmod(doc_id, 3) = 0").select("doc_key", F.lit("m").alias("markup_key"))
    new = docs.where("pmod(doc_id, 2) = 0").select("doc_key", F.when(F.pmod("doc_id", F.lit(4)) == 0, "other").otherwise("m").alias("markup_key"))
    return E.import_reports(old, new).groupBy("status", "markup_key").agg(F.count("*").alias("n"), F.count_distinct("doc_key").alias("n_docs"))


def share_error(spark, sf_dir):
    return E.share_error(_scores(spark, sf_dir).withColumn("weight", F.col("n_chars")), "source")


def model_validation(spark, sf_dir):
    """Models (weights, threshold) of each source, and what is wrong with them: 7 finite weights, threshold between 0 and 1."""
    per = S.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    models = per.select("source", F.transform(F.sequence(F.lit(1), (F.pmod("n", F.lit(3)) + 6).cast("int")), lambda k: (F.col("c") % 97) / k).alias("weights"), (F.pmod("c", F.lit(5)) / 4).alias("threshold"))
    good = F.forall("weights", lambda w: w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf")))
    return models.select("source", F.when(F.size("weights") != 7, "weights").when(~good, "finite").when((F.col("threshold") <= 0) | (F.col("threshold") >= 1), "threshold").otherwise("ok").alias("state"))


def _answers(spark, sf_dir) -> DataFrame:
    """Three raters' levels of each document; some are missing."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").withColumn("run", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    level = F.pmod(F.floor(F.col("n_chars") / (F.col("run") + 1)), F.lit(4))
    return docs.select("doc_id", "lang", "n_chars", "run", F.when(F.pmod(F.col("n_chars") + F.col("run"), F.lit(7)) != 0, level).alias("level"))


def judge_share(spark, sf_dir):
    per = _answers(spark, sf_dir).groupBy("doc_id", "lang", "n_chars").agg(F.sum("level").alias("s"), F.count("level").alias("n"))
    heavy = lambda x: F.sum(F.when(2 * F.col("s") >= x * F.col("n"), F.col("n_chars")).otherwise(0))
    seen = F.when(F.col("n") > 0, F.col("n_chars")).otherwise(0)
    known = per.withColumn("n_chars", F.col("n_chars")).withColumn("s", F.when(F.col("n") > 0, F.col("s")))
    return known.groupBy("lang").agg(E.share(heavy(3), F.sum(seen)).alias("share_suspect"), E.share(heavy(1), F.sum(seen)).alias("share_any"), F.sum(3 - F.col("n")).alias("missing"), E.share(F.sum(seen), F.sum("n_chars")).alias("coverage"))


def judge_disagree(spark, sf_dir):
    per = _answers(spark, sf_dir).groupBy("doc_id").agg(F.max("level").alias("high"), F.min("level").alias("low"), F.count("level").alias("n"))
    return per.where("n > 1 and high - low >= 2").select("doc_id", "high", "low")


def judge_prompt(spark, sf_dir):
    """The sentences of each text, numbered, in a template."""
    lines = F.transform(T.sentences(F.col("text")), lambda s, i: F.concat(F.lit("P"), (i + 1).cast("string"), F.lit(": "), F.trim(s)))
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(F.concat(F.lit("Rate each part from 0 to 3.\n"), F.array_join(lines, "\n")).cast("binary"), 256).alias("prompt_sha256"), F.size(lines).cast("long").alias("n_parts"))


def judge_parse(spark, sf_dir):
    """Answers parsed line by line: the first level of each part, whether others follow, and whether they differ."""
    digit = lambda k: F.pmod(F.floor(F.col("n_chars") / k), F.lit(4)).cast("string")
    answer = F.concat(F.lit("# model: m\nP1 "), digit(1), F.lit(" first\nP2 "), digit(3), F.lit("\nnot an answer P3 1\nP1 "), digit(5), F.lit(" again\nP12 9\nP4 "), digit(7))
    rows = S.table(spark, sf_dir, "documents").select("doc_id", answer.alias("a"))
    found = lambda k: F.regexp_extract_all("a", F.lit("(?m)^P([0-9]+) ([0-3])\\b"), F.lit(k))
    each = rows.select("doc_id", F.posexplode(F.arrays_zip(found(1).alias("n"), found(2).alias("level"))).alias("pos", "x"))
    per = each.groupBy("doc_id", F.col("x.n").cast("long").alias("part")).agg(F.min(F.struct("pos", F.col("x.level").cast("long").alias("level"))).alias("first"), F.count("*").alias("n"), F.count_distinct("x.level").alias("kinds"))
    return per.select("doc_id", "part", F.col("first.level").alias("level"), (F.col("n") > 1).alias("repeated"), (F.col("kinds") > 1).alias("conflict"))


QUERIES = {f.__name__: f for f in (metrics_at_threshold, best_f1, class_report, brier_logloss, reliability_ece, rates_by_group, balanced_accuracy, genre_table, length_buckets, topk_generators, shortcut_auc, report_import, share_error, model_validation, judge_share, judge_disagree, judge_prompt, judge_parse)}

_S = f"SELECT doc_id, hundredths * 10 AS s, positive, lang, source, n_chars, text FROM ({SCORED_SQL})"
_R = lambda a, b, d=6: f"CASE WHEN ({b}) <> 0 THEN {HALF_UP(f'({a}) / ({b})', d)} END"
_C = lambda keys, grid: f"SELECT {keys}t, count(*) FILTER (positive AND s >= t * 10) AS tp, count(*) FILTER (NOT positive AND s >= t * 10) AS fp, count(*) FILTER (positive AND s < t * 10) AS fn, count(*) FILTER (NOT positive AND s < t * 10) AS tn FROM ({_S}), (SELECT unnest({grid}) AS t) GROUP BY ALL"
_A = "SELECT doc_id, lang, n_chars, run, CASE WHEN (n_chars + run) % 7 <> 0 THEN CAST(floor(n_chars / (run + 1)) AS BIGINT) % 4 END AS level FROM documents, unnest([1, 2, 3]) AS r(run)"
_BALANCED = HALF_UP("(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2", 6)


def _auc(source: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN p > 0 AND n > 0 THEN {HALF_UP("w / (2.0 * p * n)", 6)} END AS auc, p AS n_positive, n AS n_negative FROM (
      SELECT {key}, CAST(sum(p * (2 * below + n)) AS DOUBLE) AS w, CAST(sum(p) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT {key}, v, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM ({source}) GROUP BY {key}, v)) GROUP BY {key})"""


_CLASS = f"""SELECT c.class, {_R('c.hit', 'c.hit + c.wrong')} AS precision, {_R('c.hit', 'c.hit + c.missed')} AS recall, {_R('2 * c.hit', '2 * c.hit + c.wrong + c.missed')} AS f1, c.hit + c.missed AS support FROM (
  SELECT unnest([{{'class': 'positive', 'hit': tp, 'wrong': fp, 'missed': fn}}, {{'class': 'negative', 'hit': tn, 'wrong': fn, 'missed': fp}}]) AS c FROM ({_C('', '[50]')}))"""
ORACLE_SQL = {
    "metrics_at_threshold": f"SELECT CAST(t AS BIGINT) AS threshold, {_R('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_R('2 * tp', '2 * tp + fp + fn')} AS f1, {_BALANCED} AS balanced_accuracy, {_R('fp', 'fp + tn')} AS fpr, {_R('fn', 'tp + fn')} AS fnr FROM ({_C('', THRESHOLDS)})",
    "best_f1": f"SELECT CAST(t AS BIGINT) AS threshold, f1 FROM (SELECT t, {_R('2 * tp', '2 * tp + fp + fn')} AS f1 FROM ({_C('', 'range(1, 101)')})) ORDER BY f1 DESC NULLS LAST, t LIMIT 1",
    "class_report": f"WITH r AS ({_CLASS}) SELECT * FROM r UNION ALL SELECT 'macro', {HALF_UP('avg(precision)', 6)}, {HALF_UP('avg(recall)', 6)}, {HALF_UP('avg(f1)', 6)}, CAST(sum(support) AS BIGINT) FROM r",
    "brier_logloss": f"SELECT {HALF_UP('CAST(sum((s - 1000 * y) * (s - 1000 * y)) AS DOUBLE) / count(*) / 1000000', 6)} AS brier, {HALF_UP('sum(-ln(greatest(1e-6, least(1 - 1e-6, CASE WHEN y = 1 THEN s / 1000 ELSE 1 - s / 1000 END)))) / count(*)', 5)} AS log_loss, count(*) AS n FROM (SELECT s, CASE WHEN positive THEN 1 ELSE 0 END AS y FROM ({_S}))",
    "reliability_ece": f"""WITH b AS (SELECT r.bin, count(v.s) AS n, CAST(coalesce(sum(v.s), 0) AS DOUBLE) AS s, count(*) FILTER (v.positive) AS p FROM range(12) AS r(bin) LEFT JOIN (SELECT *, least(floor(s * 12 / 1000), 11) AS bin FROM ({_S})) v ON v.bin = r.bin GROUP BY r.bin)
      SELECT CAST(bin AS BIGINT) AS bin, n, {_R('s', '1000 * n')} AS mean_score, {_R('p', 'n')} AS share_positive, (SELECT {_R('sum(abs(s - 1000 * p))', '1000 * sum(n)')} FROM b) AS ece FROM b""",
    "rates_by_group": f"SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS grp, {_R('count(*) FILTER (NOT positive AND s >= 500)', 'count(*) FILTER (NOT positive)')} AS fpr, {_R('count(*) FILTER (positive AND s < 500)', 'count(*) FILTER (positive)')} AS fnr, count(*) AS n FROM ({_S}) GROUP BY GROUPING SETS ((), (lang))",
    "balanced_accuracy": f"SELECT lang, {_BALANCED} AS balanced_accuracy FROM ({_C('lang, ', '[50]')})",
    "genre_table": f"SELECT c.source, {_R('tp', 'tp + fn')} AS high_positive, {_R('fp', 'fp + tn')} AS high_negative, auc, n_positive, n_negative FROM ({_C('source, ', '[40]')}) c JOIN ({_auc(f'SELECT source, s AS v, positive FROM ({_S})', 'source')}) a ON a.source = c.source",
    "length_buckets": f"SELECT CAST(bucket AS BIGINT) AS bucket, count(*) FILTER (positive) AS n, {_R('count(*) FILTER (positive AND s >= 400)', 'count(*) FILTER (positive)')} AS recall FROM (SELECT *, CASE WHEN w >= 400 THEN 400 WHEN w >= 150 THEN 150 WHEN w >= 50 THEN 50 ELSE 0 END AS bucket FROM (SELECT *, len({WORDS}) AS w FROM ({_S}))) GROUP BY bucket",
    "topk_generators": f"SELECT source, count(*) AS n, {_R('count(*) FILTER (s >= 400)', 'count(*)')} AS recall FROM ({_S}) WHERE positive GROUP BY source ORDER BY count(*) DESC, source LIMIT 15",
    "shortcut_auc": _auc(" UNION ALL ".join(f"SELECT '{k}' AS feature, {v} AS v, positive FROM ({_S})" for k, v in FEATURES.items()), "feature"),
    "report_import": r"""WITH d AS (SELECT doc_id, left(sha256(trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'))), 16) AS doc_key FROM documents),
      o AS (SELECT DISTINCT doc_key, 'm' AS known FROM d WHERE doc_id % 3 = 0), n AS (SELECT doc_key, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE 'm' END AS markup_key FROM d WHERE doc_id % 2 = 0)
      SELECT CASE WHEN known IS NULL THEN 'new' WHEN known = markup_key THEN 'known' ELSE 'conflict' END AS status, markup_key, count(*) AS n, count(DISTINCT n.doc_key) AS n_docs FROM n LEFT JOIN o ON o.doc_key = n.doc_key GROUP BY ALL""",
    "share_error": f"SELECT {HALF_UP('avg(e) / 10000', 4)} AS error, count(*) AS n_groups FROM (SELECT floor(abs(coalesce(sum(n_chars) FILTER (s >= 500), 0) - coalesce(sum(n_chars) FILTER (positive), 0)) * 1000000 / sum(n_chars)) AS e FROM ({_S}) GROUP BY source)",
    "model_validation": "SELECT source, CASE WHEN n % 3 + 6 <> 7 THEN 'weights' WHEN c % 5 IN (0, 4) THEN 'threshold' ELSE 'ok' END AS state FROM (SELECT source, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY source)",
    "judge_share": f"""SELECT lang, {_R('coalesce(sum(n_chars) FILTER (n > 0 AND 2 * s >= 3 * n), 0)', 'coalesce(sum(n_chars) FILTER (n > 0), 0)')} AS share_suspect, {_R('coalesce(sum(n_chars) FILTER (n > 0 AND 2 * s >= n), 0)', 'coalesce(sum(n_chars) FILTER (n > 0), 0)')} AS share_any,
      CAST(sum(3 - n) AS BIGINT) AS missing, {_R('coalesce(sum(n_chars) FILTER (n > 0), 0)', 'sum(n_chars)')} AS coverage FROM (SELECT doc_id, lang, n_chars, sum(level) AS s, count(level) AS n FROM ({_A}) GROUP BY ALL) GROUP BY lang""",
    "judge_disagree": f"SELECT doc_id, max(level) AS high, min(level) AS low FROM ({_A}) GROUP BY doc_id HAVING count(level) > 1 AND max(level) - min(level) >= 2",
    "judge_prompt": f"SELECT doc_id, sha256('Rate each part from 0 to 3.' || chr(10) || array_to_string(list_transform(range(1, len(s) + 1), lambda k: 'P' || k || ': ' || trim(s[k])), chr(10))) AS prompt_sha256, CAST(len(s) AS BIGINT) AS n_parts FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)",
    "judge_parse": r"""WITH a AS (SELECT doc_id, '# model: m' || chr(10) || 'P1 ' || n_chars % 4 || ' first' || chr(10) || 'P2 ' || (n_chars // 3) % 4 || chr(10) || 'not an answer P3 1' || chr(10) || 'P1 ' || (n_chars // 5) % 4 || ' again' || chr(10) || 'P12 9' || chr(10) || 'P4 ' || (n_chars // 7) % 4 AS a FROM documents),
      e AS (SELECT doc_id, unnest(regexp_extract_all(a, '(?m)^P([0-9]+) ([0-3])\b', 1)) AS part, unnest(regexp_extract_all(a, '(?m)^P([0-9]+) ([0-3])\b', 2)) AS level, generate_subscripts(regexp_extract_all(a, '(?m)^P([0-9]+) ([0-3])\b', 1), 1) AS pos FROM a)
      SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(arg_min(level, pos) AS BIGINT) AS level, count(*) > 1 AS repeated, count(DISTINCT level) > 1 AS conflict FROM e GROUP BY doc_id, part""",
}
