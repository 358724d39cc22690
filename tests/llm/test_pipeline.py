"""The stages of the pipeline one after the other: what each keeps, against brute force."""

import re

import corpus_pipeline as p
from pyspark.sql import functions as F

from stylometra.llm.shared import words


def shingled(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, "1234 5678 !!", "en", "s", 12), (900_002, None, "en", "s", 0), (900_003, "", None, "s", 0)], docs.schema)
    docs, kept = docs.unionByName(odd), {}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        if k < len(p.STAGES) - 1:
            assert set(docs.columns) == set(p.COLUMNS)
    texts = {name: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for name, df in list(kept.items())[:4]}
    first = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(texts["language"]) == first
    low = sorted(texts["language"])
    sets = {i: shingled(texts["language"][i]) for i in low}
    parent = {i: i for i in low}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in low:
        for b in low:
            if b < a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(texts["near duplicates"]) == {i for i in low if root(i) == i}
    items = [" " + " ".join(words(r["text"])) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {i for i, t in texts["near duplicates"].items() if any(x in f" {' '.join(words(t))} " for x in items)}
    assert set(texts["decontamination"]) == set(texts["near duplicates"]) - holds
    assert set(texts["personal data"]) == set(texts["decontamination"])
    mail = re.compile(r"[a-z.]+\.\d\d@mail\d+\.example\.com")
    assert not {m for t in texts["decontamination"].values() for m in mail.findall(t)} & {m for t in texts["personal data"].values() for m in mail.findall(t)}
    packed = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in packed} == set(texts["personal data"]) and all(r["n"] == r["m"] for r in packed)


def test_near_duplicates_are_rows(spark):
    """Repeated rows, one id with two texts, and null ids: one row of each class stays, and no row of another class goes."""
    a, b, c, d, e, f = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcdef")
    rows = [(7, a), (7, a), (7, a), (3, c), (8, c), (8, b), (None, d), (None, d), (None, e), (5, e), (None, f), (9, "One two three."), (9, "one two THREE"), (4, None), (4, None), (6, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [(r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, "").collect()]
    variants = [x for x in got if x[0] == 9]
    assert len(variants) == 1
    assert sorted(map(str, set(got))) == sorted(map(str, [(7, a), (3, c), (8, b), (None, d), (5, e), (None, f), (4, None), (6, ""), *variants]))
    assert len(got) == 11
