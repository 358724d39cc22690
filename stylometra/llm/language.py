"""Linear-chain conditional random field that labels each word of code-switched text with a language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import grouped, prepare, table, trimmed

#: words of a block of a chain; bits of features' hashes, hash buckets
BLOCK, BITS = 64, 16
BUCKETS = 1 << BITS
#: the sample to learn from: documents and words of each language, characters of a document
PER_LANGUAGE, WORDS, CHARACTERS = 240, 24_000, 50_000
#: more languages than this are an error: weights for each feature and language wouldn't fit a task
MOST_LANGUAGES = 2000
UNKNOWN = "und"


def letters(piece: str) -> str:
    """A piece between white space without what isn't a letter, in lower case; may be empty."""
    return (piece if piece.isalpha() else "".join(c for c in piece if c.isalpha())).lower()


def _mixed(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit hash of a hash and what comes after it."""
    x = (np.asarray(a, np.uint64) ^ np.asarray(b, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def flat_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of all words, one after the other, and how many each has (at least three): the word itself
    (lexicon), its length up to 12, affixes of 1 to 4 letters, all n-grams of 2 and 3 letters with borders."""
    text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(n + 2) - n - 2
    affixes = np.minimum(n, 4)
    sizes = 3 + 2 * affixes + 2 * n
    at = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.uint64)
    inside = np.arange(len(text)) - np.repeat(begin, n + 2)
    flat[at] = _mixed(np.add.reduceat(_mixed(_mixed(text, inside), text), begin), 1) if len(words) else flat[at]
    flat[at + 1] = _mixed(np.minimum(n, 12), 2)
    gram = np.zeros(len(text), np.uint64)
    for k in range(1, 5):
        gram = _mixed(gram[: len(text) - k + 1], text[k - 1 :])
        some = np.flatnonzero(n >= k)
        flat[at[some] + 1 + k] = _mixed(gram[begin[some] + 1], 3)
        flat[at[some] + 1 + affixes[some] + k] = _mixed(gram[begin[some] + 1 + n[some] - k], 4)
        if 2 <= k <= 3:
            counts = n + 3 - k
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            to = at + 2 + 2 * affixes + (n + 1 if k == 3 else 0)
            flat[np.repeat(to, counts) + place] = gram[np.repeat(begin, counts) + place]
    return ((flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64), sizes


@dataclass
class Model:
    """labels; weights of features, of a chain's first label and of transitions."""

    labels: list[str]
    weights: np.ndarray
    begin: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """The sum of the weights of each word's features."""
        if not words:
            return np.zeros((0, self.weights.shape[1]))
        flat, sizes = flat_features(words)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)

    def marginals(self, emissions: np.ndarray, there: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over blocks of chains [n, time, label]; there: which words exist (a prefix of each block);
        first: which blocks begin a chain (default: all), those after it go on with it.

        Marginals, log normalisers (of chains of one block), and for learning the scaled forward and backward messages.
        The messages that enter blocks come from the products of the blocks' transfer matrices, so a chain of any length
        is one chain, while the steps of all blocks are taken together.
        """
        n, steps, k = emissions.shape
        top = emissions.max(axis=2, keepdims=True)
        e = np.exp(emissions - top)
        begin, move = np.exp(self.begin - self.begin.max()), np.exp(self.move)
        entering, leaving = np.ones((n, k)), np.ones((n, k))
        first = np.ones(n, bool) if first is None else first
        if not first.all():
            self._messages(e, there, first, begin, move, entering, leaving)
        forward = np.empty((steps, n, k))
        scale = np.ones((steps, n))
        x = np.where(first[:, None], begin, entering @ move) * e[:, 0]
        for t in range(steps):
            if t:
                x = np.where(there[:, t, None], (forward[t - 1] @ move) * e[:, t], forward[t - 1])
            scale[t] = np.where(there[:, t], x.sum(axis=1), 1.0)
            forward[t] = x / scale[t][:, None]
        backward = np.empty((steps, n, k))
        backward[-1] = leaving
        for t in range(steps - 2, -1, -1):
            y = ((backward[t + 1] * e[:, t + 1]) @ move.T) / scale[t + 1][:, None]
            backward[t] = np.where(there[:, t + 1, None], y, leaving)
        logs = np.log(scale).sum(axis=0) + (top[..., 0] * there).sum(axis=1) + self.begin.max()
        both = forward * backward
        if not first.all():
            both /= both.sum(axis=2, keepdims=True)
        return both, logs, forward, (backward * e.transpose(1, 0, 2)) / scale[:, :, None]

    @staticmethod
    def _messages(e, there, first, begin, move, entering, leaving) -> None:
        """What enters each block from the left and from the right, up to a factor."""
        n, steps, k = e.shape
        # full blocks first, so that those that go on at a step are a view
        order = np.argsort(-there.sum(axis=1), kind="stable")
        live = there.sum(axis=0)
        sorted_e = np.ascontiguousarray(e[order].transpose(1, 0, 2)[:, :, None, :], dtype=np.float32)
        step = move.astype(np.float32)
        product = (np.where(first[order, None, None], np.eye(k), move) * sorted_e[0]).astype(np.float32)
        for t in range(1, steps):
            m = int(live[t])
            if not m:
                break
            product[:m] = (product[:m].reshape(m * k, k) @ step).reshape(m, k, k) * sorted_e[t, :m]
            if t % 8 == 0:
                product[:m] /= product[:m].max(axis=(1, 2), keepdims=True)
        through = np.empty((n, k, k))
        through[order] = product
        through /= through.max(axis=(1, 2), keepdims=True)
        begins = np.flatnonzero(first)
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        order = np.argsort(place, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(place[order])) + 1)
        out = np.empty((n, k))
        for rows in levels:
            if place[rows[0]]:
                entering[rows] = out[rows - 1]
            x = np.einsum("nk,nkj->nj", entering[rows] if place[rows[0]] else np.tile(begin, (len(rows), 1)), through[rows])
            out[rows] = x / x.sum(axis=1, keepdims=True)
        for rows in levels[:0:-1]:
            x = np.einsum("nkj,nj->nk", through[rows], leaving[rows])
            leaving[rows - 1] = x / x.sum(axis=1, keepdims=True)


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block and the place in it of every word of documents of these lengths, and which blocks begin a document."""
    per = -(-lengths // BLOCK)
    base = np.cumsum(per) - per
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = np.zeros(int(per.sum()), bool)
    first[base[per > 0]] = True
    return np.repeat(base, lengths) + inside // BLOCK, inside % BLOCK, first


def learn(texts: list[tuple[str, str]], epochs: int = 8, rate: float = 0.15, ridge: float = 1e-6, seed: int = 7) -> Model:
    """Fit on (text, language) rows: chains that switch language at random places are made of their words."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in texts})
    runs: list[tuple[int, list[str]]] = []
    room = dict.fromkeys(labels, WORDS)
    for text, lang in texts:
        words = [w for w in map(letters, text.split()) if w][: max(0, room[lang])]
        room[lang] -= len(words)
        at = 0
        while at < len(words):
            n = int(rng.integers(1, 9)) if rng.random() < 0.4 else int(rng.integers(8, BLOCK + 1))
            runs.append((labels.index(lang), words[at : at + n]))
            at += n
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, max(1, k))), np.zeros(max(1, k)), np.zeros((max(1, k), max(1, k))))
    if k < 2 or not runs:
        return model
    runs = [runs[i] for i in rng.permutation(len(runs))]
    flat = [(w, lang) for lang, words in runs for w in words]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for w, _ in flat))}
    every, sizes = flat_features([*known])
    starts = np.cumsum(sizes) - sizes
    pad = -len(flat) % BLOCK
    word = np.array([known[w] for w, _ in flat] + [0] * pad).reshape(-1, BLOCK)
    gold = np.array([y for _, y in flat] + [0] * pad).reshape(-1, BLOCK)
    there = (np.arange(len(flat) + pad) < len(flat)).reshape(-1, BLOCK)
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.begin, model.move)]
    for _ in range(epochs):
        order = rng.permutation(len(word))
        for rows in np.array_split(order, max(1, len(order) // 64)):
            y, here, which = gold[rows], there[rows], word[rows].ravel()
            count = sizes[which]
            ends = np.cumsum(count)
            f = every[np.arange(int(ends[-1])) + np.repeat(starts[which] - (ends - count), count)]
            summed = np.add.reduceat(model.weights[f], ends - count, axis=0).reshape(*y.shape, k)
            marginal, _, forward, after = model.marginals(summed, here)
            error = marginal.transpose(1, 0, 2).copy()
            error[np.arange(len(rows))[:, None], np.arange(BLOCK), y] -= 1
            error *= here[..., None]
            grad = np.stack([np.bincount(f, np.repeat(error[..., j].ravel(), count), BUCKETS) for j in range(k)], axis=1)
            pair = np.exp(model.move) * np.einsum("tni,tnj,nt->ij", forward[:-1], after[1:], here[:, 1:].astype(float))
            np.add.at(pair, (y[:, :-1][here[:, 1:]], y[:, 1:][here[:, 1:]]), -1)
            start = error[:, 0].sum(axis=0)
            for value, g, square in zip((model.weights, model.begin, model.move), (grad, start, pair), squares):
                g = g / len(rows) + ridge * value
                square += g * g
                value -= rate * g / np.sqrt(square)
    return Model(labels, model.weights.astype(np.float32), model.begin, model.move)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most per_language labelled texts of each language whose ids' crc32 is no multiple of 5.

    A language's ids are hashed into per_language classes and the smallest hash of each is taken, with partial
    aggregates only; then the texts of those ids are read. Every language is learned; only the texts of each are bounded:
    WORDS words in the first CHARACTERS of its texts, and texts beyond them don't leave Spark.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(f"t is not null and l is not null and pmod(crc32(cast(cast(i as string) as binary)), 5) != 0").withColumn("h", F.xxhash64("i"))  # noqa: F541
    chosen = rows.groupBy("l", F.pmod("h", F.lit(per_language)).alias("c")).agg(F.min("h").alias("h")).select("l", "h")
    languages = rows.select("l").distinct().count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has {languages} values, more than {MOST_LANGUAGES}: no column of languages")
    each = rows.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h").agg(F.min(F.left("t", F.lit(CHARACTERS))).alias("t"))
    before = F.sum(F.regexp_count("t", F.lit(r"\S*\p{L}\S*"))).over(W.partitionBy("l").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    found = each.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < WORDS).select("l", "h", "t").orderBy("l", "h").collect()
    return [(r["t"], r["l"]) for r in found]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score for each row, and the words of each language (marginal sums) as `words` map; df's other columns stay.

    Words are what white space separates, without what isn't a letter; every word of the text is labelled, and
    a text is one chain. The document's language has the largest sum of marginals (ties: the first in order); score is its share.
    Null text, no letters or nothing learned: `und`, score 0, no words. Repeated rows get equal answers. Columns of df
    named lang_pred, score or words are replaced.
    """
    spark = prepare(df.sparkSession)
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "words")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m: Model = shared.value
        known: dict[str, int] = {}
        scores = np.zeros((1 << 16, len(m.labels)), dtype=np.float32)

        def batch(texts):
            nonlocal known, scores
            split = [t.split() if t else [] for t in texts]
            new = [*(set().union(*split) - known.keys())]
            if len(known) + len(new) > 400_000:
                known = {}
                new = [*set().union(*split)]
            while len(known) + len(new) > len(scores):
                scores = np.concatenate([scores, np.zeros_like(scores)])
            words = [*map(letters, new)]
            full = [k for k, w in enumerate(words) if w]
            base = len(known)
            known.update(zip((new[k] for k in full), range(base, base + len(full))))
            for a in range(0, len(full), 20_000):
                part = [words[k] for k in full[a : a + 20_000]]
                scores[base + a : base + a + len(part)] = m.emissions(part)
            without = {new[k] for k in range(len(new)) if not words[k]}
            get = known.get
            at = [[i for i in map(get, s) if i is not None] if without else [*map(get, s)] for s in split]
            lengths = np.array([len(x) for x in at], dtype=np.int64)
            flat = np.fromiter((i for x in at for i in x), dtype=np.int64, count=int(lengths.sum()))
            sums = np.zeros((len(texts), len(m.labels)))
            if len(flat) and len(m.labels):
                row, column, first = chains(lengths)
                e = np.zeros((int(row[-1]) + 1, BLOCK, len(m.labels)))
                there = np.zeros(e.shape[:2], dtype=bool)
                e[row, column], there[row, column] = scores[flat], True
                marginal = m.marginals(e, there, first)[0][column, row]
                doc = np.repeat(np.arange(len(texts)), lengths)
                for j in range(len(m.labels)):
                    sums[:, j] = np.bincount(doc, marginal[:, j], len(texts))
            best = sums.argmax(axis=1) if len(m.labels) else np.zeros(len(texts), dtype=int)
            known_here = lengths > 0
            preds = [m.labels[b] if w and m.labels else UNKNOWN for b, w in zip(best, known_here)]
            score = [min(1.0, float(s[b] / n)) if w and m.labels else 0.0 for s, b, n, w in zip(sums, best, lengths, known_here)]
            by = [[(lang, float(x)) for lang, x in zip(m.labels, s)] if w else [] for s, w in zip(sums, known_here)]
            return preds, score, by

        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            out = ([], [], [])
            for group in grouped(texts, [len(t or "") for t in texts], max(50_000, 8_000_000 // max(4, len(m.labels)))):
                for x, y in zip(out, batch(group)):
                    x += y
            yield pa.record_batch([*b.columns[:-1], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.map_(pa.string(), pa.float64()))], names=[*(f"c{k}" for k in range(b.num_columns - 1)), "lang_pred", "score", "words"])

    given = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)), F.col(text_col).alias("t"))
    schema = ", ".join([*(f"c{k} {given.schema[k].dataType.simpleString()}" for k in range(len(kept))), "lang_pred string, score double, words map<string,double>"])
    return given.mapInArrow(trimmed(run), schema).toDF(*kept, "lang_pred", "score", "words")


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(sample(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
