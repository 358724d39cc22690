"""Rules on texts: findings with offsets, clusters, filters by severity, lights and kinds of lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import once

# Kinds of lines by their first signs, in the order in which they are tried.
LINES = {"empty": r"^\s*$", "heading": r"^#{1,6} ", "list": r"^\s*(?:[-*+]|[0-9]+[.)]) ", "quote": r"^>", "table": r"^\|"}
SEVERITIES = ("P0", "P1", "P2")


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    severity: str
    pattern: str


def findings(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """doc_id, rule, kind, severity, start, line, col, text of every match of every rule.

    Matches of one rule don't overlap. Texts are cut at the matches, and places, lines and columns are carried from one
    match to the next, all in the row: linear in the text, without a shuffle, and rows of one id stay apart. Null texts
    and texts without a match give no rows.
    """
    text = F.col(text_col)
    found = [F.when(text.rlike(r.pattern), F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), placed(text, r.pattern).alias("hits"))) for r in rules]
    each = docs.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    rows = each.select("doc_id", "f.rule", "f.kind", "f.severity", F.explode("f.hits").alias("h"))
    return rows.select("doc_id", "rule", "kind", "severity", "h.start", "h.line", "h.col", F.left("h.text", F.lit(160)).alias("text"))


def placed(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places: array of start, line, col, text."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = lambda x: F.lit(x).cast("long")
    begin = F.struct(number(0).alias("at"), number(1).alias("line"), number(1).alias("col"), F.array().cast("array<struct<start:bigint,line:bigint,col:bigint,text:string>>").alias("out"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
    after = lambda x, col: F.when(breaks(x) > 0, F.length(F.substring_index(x, "\n", -1)) + 1).otherwise(col + F.length(x)).cast("long")

    def step(s: Column, x: Column) -> Column:
        gap, hit = x["gap"], x["hit"]
        start, line, col = s["at"] + F.length(gap), s["line"] + breaks(gap), after(gap, s["col"])
        one = F.struct(start.alias("start"), line.alias("line"), col.alias("col"), hit.alias("text"))
        return F.struct((start + F.length(hit)).alias("at"), (line + breaks(hit)).alias("line"), after(hit, col).alias("col"), F.concat(s["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def ranges(text: Column, pattern: str) -> Column:
    """Where the matches of a pattern begin and end: array of a, z. As placed, but only lengths go through the fold."""
    sizes = lambda x: F.transform(x, lambda y: F.length(y))
    gaps, hits = sizes(F.split(text, pattern, -1)), sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start, end = s["at"] + x["gap"], s["at"] + (x["gap"] + x["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("a"), end.alias("z")))).alias("out"))

    # the last gap has no match behind it
    pairs = F.filter(F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), lambda x: x["hit"].isNotNull())
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings of this severity or a graver one."""
    return found.where(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(severity) + 1]))


def clusters(found: DataFrame, kind: str, least: int) -> DataFrame:
    """Documents in which at least `least` different rules of a kind match, with the first place of any."""
    per = found.where(F.col("kind") == kind).groupBy("doc_id").agg(F.count_distinct("rule").alias("n_rules"), F.min("start").alias("first_start"))
    return per.where(F.col("n_rules") >= least)


def n_findings(text: Column, rules: list[Rule]) -> Column:
    """How many matches all rules have; 0 for a null text."""
    return sum((F.coalesce(F.regexp_count(text, F.lit(r.pattern)), F.lit(0)) for r in rules), F.lit(0)).cast("long")


def lights(docs: DataFrame, rules: list[Rule], red: list[str], yellow: list[str], text_col: str = "text") -> DataFrame:
    """doc_id, light, n_findings: red if a rule of a red kind matches, else yellow likewise, else green. Every row has its
    own; all in the row."""
    text = F.col(text_col)
    rows = once(docs.select("doc_id", text_col), _red=n_findings(text, [r for r in rules if r.kind in red]), _yellow=n_findings(text, [r for r in rules if r.kind in yellow and r.kind not in red]), _other=n_findings(text, [r for r in rules if r.kind not in {*red, *yellow}]))
    name = F.when(F.col("_red") > 0, "red").when(F.col("_yellow") > 0, "yellow").otherwise("green")
    return rows.select("doc_id", name.alias("light"), (F.col("_red") + F.col("_yellow") + F.col("_other")).alias("n_findings"))


def line_kind(line: Column) -> Column:
    out = None
    for name, pattern in LINES.items():
        out = F.when(line.rlike(pattern), name) if out is None else out.when(line.rlike(pattern), name)
    return out.otherwise("prose")


def sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Runs of lines of one kind: doc_id, kind, first_line, n_lines, n_chars; empty lines only part them.

    Borders between runs are found in the row, so rows of one id stay apart and nothing is shuffled."""
    rows = once(docs.select("doc_id", F.split(F.col(text_col), "\n").alias("_l")), _k=F.transform("_l", line_kind))
    borders = F.filter(F.transform("_k", lambda k, i: F.when((i == 0) | (F.get("_k", i - 1) != k), i)), lambda i: i.isNotNull())
    rows = once(rows, _b=F.concat(borders, F.array(F.size("_k"))))
    each = F.transform(F.slice("_b", F.lit(1), F.size("_b") - 1), lambda b, j: F.struct(F.get("_k", b).alias("kind"), b.alias("a"), F.get("_b", j + 1).alias("z")))
    rows = rows.where("_l is not null").select("doc_id", "_l", F.explode(F.filter(each, lambda x: x["kind"] != "empty")).alias("r"))
    chars = F.aggregate(F.slice("_l", F.col("r.a") + 1, F.col("r.z") - F.col("r.a")), F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return rows.select("doc_id", "r.kind", F.col("r.a").cast("long").alias("first_line"), (F.col("r.z") - F.col("r.a")).cast("long").alias("n_lines"), chars.alias("n_chars"))


def shift_errors(scores: DataFrame, shifts: list[int], threshold: int) -> DataFrame:
    """shift, error: mean over groups of |share of scores at or above the threshold after the shift - share of positives|, in points.

    scores has grp, score (whole thousandths) and positive. Counts of equal scores come first, so what is multiplied by
    the shifts has at most one row for each group and score.
    """
    counted = scores.groupBy("grp", "score").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    moved = counted.withColumn("shift", F.explode(F.array(*(F.lit(x).cast("long") for x in shifts))))
    per = moved.groupBy("shift", "grp").agg(F.sum(F.when(F.col("score") + F.col("shift") >= threshold, F.col("n")).otherwise(0)).alias("above"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    error = F.floor(F.abs(F.col("above") - F.col("p")) * 1_000_000 / F.col("n")).cast("long")
    return per.groupBy("shift").agg(F.sum(error).alias("error"), F.count("*").alias("n_groups"))
