"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HashedWords, SIMILARITY, grouped, prepare, rolling, table, trimmed

PAD = np.uint64(0)
#: samples of one LSH key; recall to be reached for an item's worst allowed distance; how many keys are tried for it
SAMPLES, RECALL, KEYS = 3, 0.995, (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: items and their words that one pass over the documents compares; values of an array of windows; most bits of a sieve
ITEMS, WORDS, CELLS, BITS = 20_000, 4_000_000, 1_000_000, 22


class Walk:
    """CGK embedding: a string of n symbols becomes 3n symbols; a random bit of symbol and step says whether to go on.

    For two strings the Hamming distance of their embeddings under one walk is at most quadratic in their edit
    distance, and independent of where the edits are.
    """

    def __init__(self, steps: int, seed: int):
        self.odd = np.random.default_rng([77, seed]).integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, rows: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """rows [n, w] padded with PAD; the embeddings [n, steps]."""
        n, w = rows.shape
        wide = np.concatenate([rows, np.zeros((n, 1), np.uint64)], axis=1).ravel()
        base, at, top = np.arange(n) * (w + 1), np.zeros(n, np.int64), np.minimum(lengths, w)
        out = np.empty((steps, n), np.uint64)
        for j in range(steps):
            symbol = wide[base + at]
            out[j] = symbol
            at = np.minimum(at + ((symbol * self.odd[j]) >> np.uint64(63)).astype(np.int64), top)
        return out.T


def edit(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, free: bool) -> np.ndarray:
    """Distances [n, m + 1] of each item to its text's prefixes, or with `free` to their best suffixes; texts padded."""
    n, m = texts.shape
    across = np.arange(m + 1)
    last = np.zeros((n, m + 1), np.int64) if free else np.tile(across, (n, 1))
    for i in range(items.shape[1]):
        on = i < lengths
        now = np.empty_like(last)
        now[:, 0] = last[:, 0] + 1
        now[:, 1:] = np.minimum(last[:, :-1] + (texts != items[:, i : i + 1]), last[:, 1:] + 1)
        now = np.minimum.accumulate(now - across, axis=1) + across
        last = np.where(on[:, None], now, last)
    return last


@dataclass
class Items:
    """Benchmark items of like length: ids, word hashes (padded), lengths, allowed distances, the tables of the LSH
    (hash of a key, item; sorted), and seeds by their length: hash, item, place in it, and a sieve of the hashes' first
    bits. No tables: every window near a seed is verified."""

    ids: list[int]
    rows: np.ndarray
    lengths: np.ndarray
    most: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def steps(self) -> int:
        return 3 * self.rows.shape[1]


class Texts:
    """Word hashes of documents, one after the other and PAD at the end; `begins` has the first of each, and the end."""

    def __init__(self, hashes: list[np.ndarray]):
        self.flat = np.concatenate([*hashes, np.array([PAD])])
        self.begins = np.cumsum([0, *map(len, hashes)])
        self.runs: dict[int, np.ndarray] = {}

    def rolling(self, n: int) -> np.ndarray:
        """Hashes of each n consecutive words, kept for further items; some run over the end of a document."""
        if n not in self.runs:
            self.runs[n] = rolling(self.flat[:-1], n)
        return self.runs[n]


def sampled(key: int, rows: np.ndarray, lengths: np.ndarray, steps: int, samples: int = SAMPLES) -> np.ndarray:
    """A hash of the symbols of the rows' embeddings at the places that this key samples, and of the lengths."""
    at = np.floor(np.random.default_rng([3, key]).random(samples)[None, :] * (3 * lengths)[:, None]).astype(np.int64)
    found = np.take_along_axis(Walk(steps, key)(rows, lengths, steps), at, axis=1)
    return rolling(np.concatenate([found, lengths[:, None].astype(np.uint64)], axis=1).T.copy(), samples + 1)[0]


def keys_needed(rows: np.ndarray, lengths: np.ndarray, most: np.ndarray, samples: int, recall: float, trials: int = 400) -> int:
    """LSH keys that reach the recall, as measured on random edits of the items at the largest distance allowed; 0 if none do."""
    rng = np.random.default_rng(5)
    pick = rng.integers(0, len(rows), trials)
    pairs = []
    for k in pick:
        x = [*map(int, rows[k, : lengths[k]])]
        y = x[:]
        for _ in range(int(most[k])):
            p, kind = int(rng.integers(0, len(y) + 1)), int(rng.integers(0, 3))
            new = int(rng.integers(1, 1 << 62))
            y = y[:p] + [new] + y[p + (kind == 0) :] if kind < 2 else y[: max(0, p - 1)] + y[p:]
        pairs.append((y + [0] * len(x))[: len(x)])
    edited = np.zeros((trials, rows.shape[1]), np.uint64)
    for r, y in zip(edited, pairs):
        r[: len(y)] = np.array(y, np.uint64)
    same = np.zeros(trials)
    for seed in range(8):
        walk = Walk(3 * rows.shape[1], 1000 + seed)
        equal = walk(rows[pick], lengths[pick], walk.odd.size) == walk(edited, lengths[pick], walk.odd.size)
        inside = np.arange(walk.odd.size) < 3 * lengths[pick][:, None]
        same += ((equal & inside).sum(axis=1) / (3 * lengths[pick])) ** samples / 8
    missed = lambda keys: float(np.mean((1 - np.minimum(same, 1)) ** keys))
    return next((k for k in KEYS if missed(k) <= 1 - recall), 0)


def prepare_items(items: list[tuple[int, str | None]], similarity: float = SIMILARITY, samples: int = SAMPLES, recall: float = RECALL) -> list[Items]:
    """Items with words, in classes in which the longest has at most twice the words of the shortest.

    An item of n words allows floor((1 - similarity) n) edits of words. Cut into one part more than these edits, it
    leaves at least one part whole in any match: these parts are its seeds.
    """
    found = [(i, w) for i, w in zip([i for i, _ in items], HashedWords().many([t for _, t in items])) if len(w)]
    classes: dict[int, list] = {}
    for x in found:
        classes.setdefault(len(x[1]).bit_length(), []).append(x)
    return [_class_of(some, similarity, samples, recall) for _, some in sorted(classes.items())]


def _class_of(found: list[tuple[int, np.ndarray]], similarity: float, samples: int, recall: float) -> Items:
    lengths = np.array([len(w) for _, w in found])
    rows = np.zeros((len(found), int(lengths.max())), np.uint64)
    for r, (_, w) in zip(rows, found):
        r[: len(w)] = w
    most = np.array([int(math.floor((1 - similarity) * n + 1e-9)) for n in lengths])
    seeds: dict[int, list] = {}
    for k, (n, d) in enumerate(zip(lengths, most)):
        q = int(n) // (int(d) + 1)
        for p in range(int(d) + 1):
            seeds.setdefault(q, []).append((rolling(rows[k, p * q : p * q + q], q)[0], k, p * q))
    arrays = {}
    for q, s in seeds.items():
        s.sort()
        hashes, bits = np.array([x[0] for x in s], np.uint64), min(BITS, len(s).bit_length() + 6)
        sieve = np.zeros(1 << bits, bool)
        sieve[hashes >> np.uint64(64 - bits)] = True
        arrays[q] = (hashes, np.array([x[1] for x in s]), np.array([x[2] for x in s]), sieve)
    out = Items([i for i, _ in found], rows, lengths, most, [], arrays)
    for key in range(keys_needed(rows, lengths, most, samples, recall)):
        hashes = np.concatenate([sampled(key, rows[a : a + 4096], lengths[a : a + 4096], out.steps, samples) for a in range(0, len(rows), 4096)])
        order = np.argsort(hashes, kind="stable")
        out.tables.append((hashes[order], order))
    return out


def distinct(doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The different rows of these columns, in order."""
    rows = np.stack([doc, item, start], axis=1)[np.lexsort((start, item, doc))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[: len(rows)]]


def near_seeds(items: Items, texts: Texts) -> np.ndarray:
    """(document, item, start) of the windows in which a seed says that a match may be, distinct, in order; a row each."""
    found = [np.empty((0, 3), np.int64)]
    for q, (seed, item, offset, sieve) in items.seeds.items():
        here = texts.rolling(q)
        hit = np.flatnonzero(sieve[here >> np.uint64(65 - len(sieve).bit_length())])
        left = np.searchsorted(seed, here[hit], "left")
        doc = np.searchsorted(texts.begins, hit, "right") - 1
        on = (seed[np.minimum(left, len(seed) - 1)] == here[hit]) & (hit + q <= texts.begins[doc + 1])
        hit, left, doc = hit[on], left[on], doc[on]
        count = np.searchsorted(seed, here[hit], "right") - left
        every = np.repeat(np.arange(len(hit)), count)
        which = np.repeat(left, count) + np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
        rows = max(1, CELLS // (2 * int(items.most.max()) + 1))
        for a in range(0, len(every), rows):
            d, k = doc[every[a : a + rows]], item[which[a : a + rows]]
            at = hit[every[a : a + rows]] - texts.begins[d] - offset[which[a : a + rows]]
            wide = 2 * items.most[k] + 1
            shift = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) - np.repeat(items.most[k], wide)
            d = np.repeat(d, wide)
            found.append(distinct(d, np.repeat(k, wide), np.clip(np.repeat(at, wide) + shift, 0, texts.begins[d + 1] - texts.begins[d] - 1)))
    return distinct(*np.concatenate(found).T)


def retrieved(items: Items, texts: Texts, near: np.ndarray) -> np.ndarray:
    """(document, item, start) that share a key of the LSH, in order. Text without any seed can hold no match; of all
    other text each window of an item's length is embedded and looked up, whichever item the seed was of."""
    doc, item, start = near.T
    if not items.tables:
        return near
    place = distinct(doc, start, items.lengths[item])
    out, rows = [np.empty((0, 3), np.int64)], max(1, CELLS // items.steps)
    for a in range(0, len(place), rows):
        d, s, n = place[a : a + rows].T
        text = windows(texts, d, s, n, items.rows.shape[1])
        for key, (table, which) in enumerate(items.tables):
            mine = sampled(key, text, n, items.steps)
            left = np.searchsorted(table, mine, "left")
            count = np.searchsorted(table, mine, "right") - left
            hit = np.flatnonzero(count)
            count = count[hit]
            at = np.repeat(left[hit], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(hit, count)
            out.append(distinct(d[row], which[at], s[row]))
    return distinct(*np.concatenate(out).T)


def windows(texts: Texts, doc: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` words from start, PAD beyond length or the text's end."""
    at = texts.begins[doc][:, None] + start[:, None] + np.arange(width)
    there = (np.arange(width) < length[:, None]) & (at < texts.begins[doc + 1][:, None])
    return texts.flat[np.where(there, at, len(texts.flat) - 1)]


def matches(classes: list[Items], hashes: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item's id, item's words, distance, first word, words) of the best match of each document and item
    within the distance."""
    out, texts = [], Texts(hashes)
    for items in classes:
        out += _matches(items, texts)
    return out


def _matches(items: Items, texts: Texts) -> list[tuple[int, int, int, int, int, int]]:
    near = near_seeds(items, texts)
    if not len(near):
        return []
    doc, item, start = retrieved(items, texts, near).T
    if not len(doc):
        return []
    # windows of one item that overlap are one region, verified at once
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > items.lengths[item[1:]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    d, k, most, n = doc[first], item[first], items.most[item[first]], items.lengths[item[first]]
    begin = np.maximum(0, start[first] - most)
    reach = np.minimum(start[last] + n + 2 * most, np.diff(texts.begins)[d]) - begin
    best: dict[tuple[int, int], tuple[int, int]] = {}
    order = np.argsort(reach, kind="stable")
    while len(order):
        some = order[: max(1, CELLS // (8 * int(reach[order[min(len(order), 4096) - 1]])))][:4096]
        order = order[len(some) :]
        text = windows(texts, d[some], begin[some], reach[some], int(reach[some].max()))
        distance = edit(items.rows[k[some]], n[some], text, True)
        distance[np.arange(distance.shape[1]) > reach[some][:, None]] = 1 << 20
        end = distance.argmin(axis=1)
        for r, e, x in zip(some, end.tolist(), distance[np.arange(len(some)), end].tolist()):
            if x <= most[r]:
                place = (int(d[r]), int(k[r]))
                best[place] = min(best.get(place, (1 << 30, 0)), (x, int(begin[r]) + e))
    out = []
    found = sorted(best)
    for a in range(0, len(found), 1024):
        d, k = np.array(found[a : a + 1024]).T
        least, end = np.array([best[x] for x in found[a : a + 1024]]).T
        reach = np.minimum(items.lengths[k] + items.most[k], end)
        text = windows(texts, d, end - reach, reach, max(1, int(reach.max())))
        back, turned = np.zeros_like(text), np.zeros_like(items.rows[k])
        for r in range(len(d)):
            back[r, : reach[r]] = text[r, : reach[r]][::-1]
            turned[r, : items.lengths[k[r]]] = items.rows[k[r], : items.lengths[k[r]]][::-1]
        distance = edit(turned, items.lengths[k], back, False)
        distance[np.arange(distance.shape[1]) > reach[:, None]] = 1 << 20
        n = distance.argmin(axis=1)
        out += [(int(x), items.ids[y], int(items.lengths[y]), int(v), int(e - m), int(m)) for x, y, v, e, m in zip(d, k, least, end, n)]
    return out


def blocks(benchmark: DataFrame, item_col: str, item_text_col: str):
    """Lists of (item, text) of at most ITEMS items and about WORDS words, so that what is broadcast is bounded."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"] or "") // 6
        if len(block) == ITEMS or size >= WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, similarity, start_word, n_words: the best match of each document and benchmark item.

    A match is a run of words whose edit distance (in words, without regard to case and punctuation) to the whole item
    is at most (1 - similarity) of the item's words. Items go to the tasks in blocks of at most ITEMS items
    and WORDS words, one pass over the documents for each block; documents aren't shuffled.

    Null or empty texts match nothing, and so do items without words. Repeated documents and items each give rows of
    their own; null ids stay null. Empty tables: no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    schema = "doc_id long, item_id long, distance long, similarity double, start_word long, n_words long"

    def part(block):
        items = spark.sparkContext.broadcast(prepare_items(block, similarity))

        def run(batches):
            import pyarrow as pa

            hashed = HashedWords()
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                out = []
                for group in grouped([*zip(ids, texts)], [len(t or "") for t in texts], 16_000_000):
                    words = [h for some in grouped([t for _, t in group], [len(t or "") for _, t in group], 4_000_000) for h in hashed.many(some)]
                    for d, item, size, distance, first, n in matches(items.value, words):
                        out.append((group[d][0], item, distance, 1 - distance / size, first, n))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in schema.split(", ")])

        return rows.mapInArrow(trimmed(run), schema)

    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        out = part(block) if out is None else out.unionByName(part(block))
    return part([]) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text holds a match of any item; each task filters its own rows."""
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def without(items, frame):
        shared = spark.sparkContext.broadcast(prepare_items(items, similarity))

        def run(batches):
            import pyarrow as pa

            hashed = HashedWords()
            for b in batches:
                texts = b.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for group in grouped([*enumerate(texts)], [len(t or "") for t in texts], 16_000_000) if shared.value else ():
                    words = [h for some in grouped([t for _, t in group], [len(t or "") for _, t in group], 4_000_000) for h in hashed.many(some)]
                    keep[[group[d][0] for d, *_ in matches(shared.value, words)]] = False
                yield b.filter(pa.array(keep))

        return frame.mapInArrow(trimmed(run), frame.schema)

    out = docs
    for block in blocks(benchmark, item_col, item_text_col):
        out = without(block, out)
    return out


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every document with every benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
