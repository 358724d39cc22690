"""Queries of feature vectors and tree ensembles on them, on texts with passages of our own before them, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ensembles as M
from ..operators.ensembles import Node
from .queries import HALF_UP, SENTENCES, WORDS
from .rules import _lit
from .structure import MARKED_SQL, RULES, _marked

FLAGS = ("not-x-but-y", "negation-chain", "chat-markup", "lead-in")
NAMES = M.feature_names(FLAGS)
_AT = {n: i for i, n in enumerate(NAMES)}
#: a small ensemble of our own: three trees of one to three levels and a tree that is a leaf
START = -0.25
TREES = [
    Node(0, 0, _AT["sentence-mean"], 9.5, 1, 2, 0.0), Node(0, 1, _AT["comma"], 8.0, 3, 4, 0.0), Node(0, 2, -1, 0.0, 0, 0, 0.5), Node(0, 3, -1, 0.0, 0, 0, -0.75), Node(0, 4, -1, 0.0, 0, 0, 0.125),
    Node(1, 0, _AT["rule:not-x-but-y"], 0.5, 1, 2, 0.0), Node(1, 1, -1, 0.0, 0, 0, -0.5), Node(1, 2, _AT["word:и"], 0.25, 3, 4, 0.0), Node(1, 3, -1, 0.0, 0, 0, 0.25), Node(1, 4, _AT["mattr"], 0.75, 5, 6, 0.0), Node(1, 5, -1, 0.0, 0, 0, 1.5), Node(1, 6, -1, 0.0, 0, 0, 1.0),
    Node(2, 0, _AT["long-words"], 12.0, 1, 2, 0.0), Node(2, 1, -1, 0.0, 0, 0, 0.375), Node(2, 2, -1, 0.0, 0, 0, -0.625),
    Node(3, 0, -1, 0.0, 0, 0, 0.0625),
]


def _vectors(spark, sf_dir):
    patterns = {r.name: r.pattern for r in RULES}
    return M.with_features(_marked(spark, sf_dir), {f: F.col("text").rlike(patterns[f]) for f in FLAGS})


def feature_vector(spark, sf_dir):
    """The features of a text that aren't 0."""
    rows = _vectors(spark, sf_dir).select("doc_id", F.posexplode("features").alias("k", "value")).where("value != 0")
    return rows.select("doc_id", F.get(F.lit(NAMES), F.col("k")).alias("feature"), T.rounded(F.col("value"), 6).alias("value"))


def tree_score(spark, sf_dir):
    """The raw score and the probability of a small ensemble."""
    rows = _vectors(spark, sf_dir).select("doc_id", M.ensemble_score(F.col("features"), TREES, START).alias("raw"))
    return rows.select("doc_id", "raw", T.rounded(T.sigmoid(F.col("raw")), 6).alias("probability"))


QUERIES = {f.__name__: f for f in (feature_vector, tree_score)}

_RE = {r.name: r.pattern.replace("(?iu)", "(?i)") for r in RULES}
_CV = HALF_UP(f"sqrt(greatest(0.0, (list_sum(list_transform(z, lambda x: x * x)) - list_sum(z) * list_sum(z) / len(z)) / (len(z) - 1))) / (list_sum(z) / len(z))", 4)
_VECTORS = f"""d AS (SELECT doc_id, text, list_transform({WORDS}, lambda x: lower(x)) AS w, list_filter(list_transform({SENTENCES}, lambda s: CAST(len({WORDS.replace('text,', 's,')}) AS BIGINT)), lambda n: n >= 3) AS z FROM (SELECT doc_id, text FROM ({MARKED_SQL}))),
n AS (SELECT doc_id, greatest(len(w), 1) AS n FROM d),
u AS (SELECT doc_id, sum(len(list_distinct(w[k : k + {M.WINDOW - 1}]))) AS u, max(len(w)) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - {M.WINDOW - 2})) AS k FROM d WHERE len(w) >= {M.WINDOW}) GROUP BY doc_id),
words AS (SELECT doc_id, replace(w, 'ё', 'е') AS w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
v AS MATERIALIZED ({' UNION ALL '.join(f"SELECT doc_id, {_lit('rule:' + f)} AS feature, CAST(regexp_matches(text, {_lit(_RE[f])}) AS INT)::DOUBLE AS value FROM d" for f in FLAGS)}
UNION ALL SELECT doc_id, 'sentence-mean', {HALF_UP(HALF_UP('list_sum(z) / len(z)', 4), 2)} FROM d WHERE len(z) > 0
UNION ALL SELECT doc_id, 'sentence-cv', {HALF_UP(_CV, 3)} FROM d WHERE len(z) > 1
UNION ALL SELECT doc_id, 'mattr', {HALF_UP(f"u / ({M.WINDOW} * (n - {M.WINDOW - 1}))", 6)} FROM u
UNION ALL SELECT doc_id, 'word-length', coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n FROM d JOIN n USING (doc_id)
UNION ALL SELECT doc_id, 'long-words', 100.0::DOUBLE * len(list_filter(w, lambda x: length(x) >= {M.LONG_WORD})) / n FROM d JOIN n USING (doc_id)
{' '.join(f"UNION ALL SELECT doc_id, '{k}', 100.0::DOUBLE * (length(text) - length(replace(text, '{s}', ''))) / n FROM d JOIN n USING (doc_id)" for k, s in M.SIGNS.items())}
UNION ALL SELECT doc_id, 'word:' || w, 100.0::DOUBLE * c / n FROM words JOIN n USING (doc_id) WHERE w IN ({', '.join(map(_lit, M.FUNCTION_WORDS))}))"""
_NODES = ", ".join(f"({n.tree}, {n.node}, {_lit(NAMES[n.feature]) if n.feature >= 0 else 'NULL'}, {n.threshold}::DOUBLE, {n.left}, {n.right}, {n.value}::DOUBLE)" for n in TREES)
ORACLE_SQL = {
    "feature_vector": f"WITH {_VECTORS} SELECT doc_id, feature, {HALF_UP('value', 6)} AS value FROM v WHERE value <> 0",
    "tree_score": f"""WITH RECURSIVE {_VECTORS}, nodes(tree, node, feature, threshold, l, r, value) AS (VALUES {_NODES}),
      walk AS (SELECT doc_id, tree, node FROM d, nodes WHERE node = 0 UNION ALL
        SELECT walk.doc_id, walk.tree, CASE WHEN coalesce(v.value, 0) <= threshold THEN l ELSE r END FROM walk JOIN nodes USING (tree, node) LEFT JOIN v ON v.doc_id = walk.doc_id AND v.feature = nodes.feature WHERE nodes.feature IS NOT NULL),
      s AS (SELECT doc_id, {START} + sum(value ORDER BY tree) AS raw FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY doc_id)
      SELECT doc_id, CAST(raw AS DOUBLE) AS raw, {HALF_UP('1 / (1 + exp(-raw))', 6)} AS probability FROM s""",
}
