"""Preference formatting: the longest common turn prefix as one prompt, and masked completions of either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import table

END = "<|end|>\n"
FIRST = -(2**63)
SPANS = "array<struct<start:bigint,length:bigint>>"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(header(x["role"]), x["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Where the texts and end marks of assistant turns are in the rendered string."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        head, body = F.length(header(x["role"])), F.length(x["text"]) + len(END)
        span = F.struct((s["at"] + head).alias("start"), body.cast("long").alias("length"))
        return F.struct((s["at"] + head + body).alias("at"), F.when(x["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with in common, by place, role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _long_pairs(sized: DataFrame, keys: Sequence[str], most: int, of) -> DataFrame:
    """Pairs of more than `most` turns in parts: keys, part_no, a, b and the turns of the part that are common."""
    place = F.row_number().over(W.partitionBy(*keys, "side").orderBy("turn", "role", "text")) - 1
    placed = sized.withColumn("place", place)
    equal = (F.count("*") == 2) & (F.min("role") == F.max("role")) & (F.min("text") == F.max("text"))
    differ = placed.groupBy(*keys, "place").agg(equal.alias("same")).where("not same").groupBy(*keys).agg(F.min("place").alias("differ"))
    part = F.floor(F.col("place") / max(1, most // 2)).cast("long")
    parts = placed.withColumn("part_no", part).groupBy(*keys, "part_no").agg(of("chosen").alias("a"), of("rejected").alias("b")).join(differ, [*keys], "left")
    size = F.greatest(F.size("a"), F.size("b"))
    return parts.select(*keys, "part_no", "a", "b", F.greatest(F.lit(0), F.least(size, F.coalesce(F.col("differ") - F.col("part_no") * max(1, most // 2), size))).cast("int").alias("n"))


def format_preferences(turns: DataFrame, keys: Sequence[str] = ("pair_id",), most: int | None = None) -> DataFrame:
    """One row per preference pair: keys, part_no, prompt, chosen, rejected, chosen_loss, rejected_loss.

    turns: keys, side ('chosen' or 'rejected'), turn, role, text; other columns are ignored. keys name a pair; the last
    may be the pair's id and those before it what the table is partitioned by already. A side's turns are in the order
    of turn (ties: role, text). The prompt is the longest common prefix of turns by place, with equal roles and texts,
    rendered once; chosen and rejected are what follows, and of either completion the loss spans (start and length in
    its characters) are the texts and end marks of assistant turns; nothing of the prompt bears loss.

    Every pair is one row with part_no 0, whatever its turns. Only where `most` is given, a pair of more turns isn't
    gathered: its turns are numbered by a window that spills, and its strings go on in rows part_no 1, 2, ..., of half as
    many turns of either side, to be joined in that order; spans count in their own row. Null text or role: empty.
    Null turn: before all others. Rows without pair or with another side are left out. Repeated rows are turns of their
    own. A pair with one side only has no prompt. An empty table: no rows.
    """
    rows = turns.where(F.col("side").isin("chosen", "rejected")).dropna(subset=[*keys]).select(
        *keys, "side", F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text"))))
    sized = rows if most is None else rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    short = (rows if most is None else sized.where(F.col("_n") <= most)).groupBy(*keys).agg(of("chosen").alias("a"), of("rejected").alias("b"))
    short = short.select(*keys, F.lit(0).cast("long").alias("part_no"), "a", "b", common_turns(F.col("a"), F.col("b")).alias("n"))
    both = short if most is None else short.unionByName(_long_pairs(sized.where(F.col("_n") > most), keys, most, of))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    cut = both.select(*keys, "part_no", F.slice("a", 1, F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(*keys, "part_no", rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"), loss_spans(F.col("a")).alias("chosen_loss"), loss_spans(F.col("b")).alias("rejected_loss"))


def branched_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a table without preferences: every conversation is the chosen side of one pair; the rejected
    side leaves it at a turn that its id fixes and goes on with the turns of its neighbour (conv_id xor 1).

    couple (conv_id / 2) holds both; the table is partitioned by it once, for this and for all that follows.
    """
    rows = conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("couple"), "conv_id", "turn", "role", "text")
    even = F.pmod("conv_id", F.lit(2)) == 0
    last = lambda side: F.max(F.when(side, F.coalesce("turn", F.lit(0)))).over(W.partitionBy("couple"))
    rows = rows.withColumns({"own": F.when(even, last(even)).otherwise(last(~even)), "other": F.when(even, last(~even)).otherwise(last(even))})
    branch = lambda top: 1 + F.pmod("couple", F.greatest(F.lit(1), top))
    theirs = F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))
    entry = lambda pair, side: F.struct(pair.alias("pair_id"), F.lit(side).alias("side"))
    sides = F.array(
        entry(F.col("conv_id"), "chosen"),
        F.when(F.col("turn") < branch(F.col("own")), entry(F.col("conv_id"), "rejected")),
        F.when(F.col("other").isNotNull() & (F.col("turn") >= branch(F.col("other"))), entry(theirs, "rejected")),
    )
    return rows.withColumn("s", F.explode(F.filter(sides, lambda x: x.isNotNull()))).select("couple", "s.pair_id", "s.side", "turn", "role", "text")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table in a preference pair: prompt, masked completions, loss spans as start:length."""
    spans = lambda x: F.array_join(F.transform(x, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",").alias(x)
    pairs = format_preferences(branched_pairs(table(spark, sf_dir, "conversations")), ("couple", "pair_id"))
    return pairs.select("pair_id", "part_no", "prompt", "chosen", "rejected", spans("chosen_loss"), spans("rejected_loss"))


OP1_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id AS pair_id, 1 + CAST(floor(conv_id / 2) AS BIGINT) % greatest(1, max(coalesce(turn, 0))) AS branch FROM c GROUP BY conv_id),
t AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL SELECT b.pair_id, 'rejected', c.turn, c.role, c.text FROM b JOIN c ON c.conv_id = b.pair_id WHERE c.turn < b.branch
  UNION ALL SELECT b.pair_id, 'rejected', c.turn, c.role, c.text FROM b JOIN c ON c.conv_id = xor(b.pair_id, 1) WHERE c.turn >= b.branch
), p AS (
  SELECT pair_id, coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 'chosen'), []) AS a,
    coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 'rejected'), []) AS b FROM t GROUP BY pair_id
), n AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda k: k > len(a) OR k > len(b) OR a[k] <> b[k])), greatest(len(a), len(b)) + 1) - 1 AS n FROM p),
r AS (SELECT pair_id, a[1 : n] AS p, a[n + 1 :] AS a, b[n + 1 :] AS b FROM n),
h AS (SELECT pair_id, list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS p, a AS ta, b AS tb,
  list_transform(a, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS a,
  list_transform(b, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS b FROM r)
SELECT pair_id, CAST(0 AS BIGINT) AS part_no, array_to_string(p, '') AS prompt, array_to_string(a, '') AS chosen, array_to_string(b, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda k: ta[k].role = 'assistant'), lambda k: (length(array_to_string(a[1 : k - 1], '')) + length(ta[k].role) + 5) || ':' || (length(ta[k].text) + 8)), ',') AS chosen_loss,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda k: tb[k].role = 'assistant'), lambda k: (length(array_to_string(b[1 : k - 1], '')) + length(tb[k].role) + 5) || ':' || (length(tb[k].text) + 8)), ',') AS rejected_loss
FROM h
"""
