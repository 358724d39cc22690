"""Exact removal of byte strings that documents share, by external induced sorting of suffixes.

1. Every window of LENGTH bytes has an anchor: of its GRAM-byte strings the one with the least hash, leftmost among equal
   ones. Equal windows have equal anchors at the same place. Anchors' hashes are dealt into buckets; those of one text
   only can be in no match.
2. Texts (equal ones once) meet their shared anchors, and each run of windows around a shared anchor is sent to the
   anchor's bucket as one short string, so that equal windows meet in one bucket whatever their documents.
3. In each bucket, windows that no other has the hash of drop out; of what is left, equal strings once, each bucket sorts
   the suffixes by induction. Runs of suffixes with a common prefix of LENGTH
   bytes are equal windows; those of documents above the run's smallest are removed.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, grouped, materialize, prepare, table, trimmed
from .suffixes import sorted_suffixes

LENGTH, GRAM = 50, 20
#: bytes of the input files for one bucket; bytes of texts whose anchors are found at once
BUCKET, AT_ONCE = 10 << 20, 1 << 18
#: tasks of a stage; where there are more buckets, a task takes several, one after the other
TASKS = 20_000
_HASH = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out += b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all strings of `length` symbols, by doubling; AT_ONCE of them at once."""
    n = len(text) - length + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, AT_ONCE):
        part = text[a : a + AT_ONCE + length - 1]
        power, k = {1: _HASH[part]}, 1
        with np.errstate(over="ignore"):
            while 2 * k <= length:
                power[2 * k] = _mixed(power[k][:-k], power[k][k:])
                k *= 2
            found, done = power[k], k
            while done < length:
                k = 1 << ((length - done).bit_length() - 1)
                more = power[k][done:]
                m = min(len(more), len(found))
                found, done = _mixed(found[:m], more[:m]), done + k
        out[a : a + AT_ONCE] = found[: len(part) - length + 1]
    return out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: text number, first window, windows, anchor's place (in its text), anchor's hash.

    About AT_ONCE bytes of texts go at once, as the hashes take some 80 bytes for each byte."""
    parts, base = [], 0
    for group in grouped(texts, [len(t) for t in texts], AT_ONCE) if texts else [[]]:
        text, *rest = _anchors(group, length, gram)
        parts.append((text + base, *rest))
        base += len(group)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(texts: list[bytes], length: int, gram: int):
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    hashes = window_hashes(data, gram)
    value = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    wide, w = length - gram + 1, 1
    least = value
    while 2 * w <= wide:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    least = np.minimum(least[: len(value) - wide + 1], least[wide - w : wide - w + len(value) - wide + 1])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    there = np.zeros(len(place) + 1, np.int64)
    fits = sizes >= length
    np.add.at(there, (ends - sizes)[fits], 1)
    np.add.at(there, (ends - length + 1)[fits], -1)
    there = np.cumsum(there[:-1]) > 0
    change = np.flatnonzero(there & np.concatenate([[True], (place[1:] != place[:-1]) | ~there[:-1]]))
    last = np.flatnonzero(there & np.concatenate([(place[1:] != place[:-1]) | ~there[1:], [True]]))
    at = place[change]
    text = np.searchsorted(ends, change, "right")
    base = (ends - sizes)[text]
    return text, change - base, last - change + 1, at - base, hashes[at]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % n


def mark_of(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def _blob(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def _parts(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts.astype(np.int64))[:-1])


def pressed(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(data, codec="zstd", asbytes=True)


def unpacked(nodes: bytes, twins: bytes, docs: bytes, counts: bytes, starts: bytes, sizes: bytes, marks: bytes, data: bytes):
    """(node, twin, doc, starts, sizes, marks, data) of each text of a packed row of windows."""
    import pyarrow as pa

    count, start, size, mark = (np.frombuffer(x, "<u4") for x in (counts, starts, sizes, marks))
    total = int(size.sum(dtype=np.int64))
    text, begin = pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True), 0
    names = (np.frombuffer(x, "<i8").tolist() for x in (nodes, twins, docs))
    for node, twin, doc, a, n, m in zip(*names, *(_parts(x, count) for x in (start, size, mark))):
        end = begin + int(n.sum(dtype=np.int64))
        yield node, twin, doc, a, n, m, text[begin:end]
        begin = end


def equal_windows(strings: list[bytes], lowest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document that each window of each string is in, one string after the other, and where each begins.

    lowest: each string's smallest document. A window whose hash no other one has is in its own string only. Runs of the
    others are cut out, equal ones once, and so on while that leaves less to sort.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    first = np.cumsum(counts) - counts
    joined = b"".join(strings)
    kind = np.int32 if len(joined) < 1 << 31 else np.int64
    there = np.repeat((starts - first).astype(kind), counts)
    there += np.arange(len(there), dtype=kind)
    hashes = window_hashes(np.frombuffer(joined, np.uint8), length)[there]
    del there
    order = np.argsort(hashes)
    hashes = hashes[order]
    alone = np.ones(len(order) + 1, bool)
    np.not_equal(hashes[1:], hashes[:-1], out=alone[1:-1])
    shared = np.empty(len(order), bool)
    shared[order] = ~(alone[1:] & alone[:-1])
    del hashes, order, alone
    flat = np.repeat(lowest, counts)
    begins = np.zeros(len(flat), bool)
    begins[first] = True
    run = np.flatnonzero(shared & (begins | ~np.concatenate([[False], shared[:-1]])))
    if not len(run):
        return flat, first
    last = np.flatnonzero(shared & np.concatenate([begins[1:] | ~shared[1:], [True]])) + 1
    del begins, shared
    of = np.searchsorted(first, run, "right") - 1
    index: dict[bytes, int] = {}
    at = (starts - first)[of] + run
    name = np.array([index.setdefault(joined[a:z], len(index)) for a, z in zip(at.tolist(), (at + last - run + length - 1).tolist())], np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, name, lowest[of])
    rest = [*index]
    del index, joined
    fewer = sum(map(len, rest)) < 0.9 * int(sizes.sum())
    found, begin = (equal_windows if fewer else sorted_windows)(rest, least, length)
    n = last - run
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    flat[np.repeat(run, n) + inner] = found[np.repeat(begin[name], n) + inner]
    return flat, first


def sorted_windows(strings: list[bytes], lowest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As equal_windows, by sorting all suffixes."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text = text + np.uint8(1) if not len(text) or text.max() < 255 else text.astype(np.uint16) + np.uint16(1)
    text[starts + sizes] = 0
    rows, common = sorted_suffixes(text, length)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    del text
    owner = np.repeat(np.arange(len(strings), dtype=kind), sizes + 1)
    of = owner[rows]
    del owner
    inside = np.asarray(rows) - starts.astype(kind)[of]
    window = inside + kind(length) <= sizes.astype(kind)[of]
    group = np.cumsum(np.asarray(common) < length, dtype=kind)[window]
    of, inside = of[window], inside[window]
    del rows, common, window
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, lowest[of])
    counts = sizes - length + 1
    first = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int64)
    flat[first[of] + inside] = least[group]
    return flat, first


def shared_anchors(rows: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """The anchors that two texts or more have, packed: target (part of the texts), nodes, counts and marks, a row for each
    bucket and target and not for each text. rows: node long, text binary."""

    def cut(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for b in batches:
            nodes, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for group in grouped([*zip(nodes, texts)], [len(t) for t in texts], 4_000_000):
                fresh = []
                for node, text in group:
                    if node not in seen:
                        fresh.append((node, text))
                        seen.add(node)
                if len(seen) > 500_000:
                    seen = set()
                if not fresh:
                    continue
                text, _, _, _, hashes = anchors([t for _, t in fresh], length, gram)
                bucket = bucket_of(hashes, buckets)
                order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
                name = np.array([n for n, _ in fresh], np.int64)[text[order]]
                mark, bucket = mark_of(hashes)[order], bucket[order]
                heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
                pieces = [(int(bucket[a]), mark[a:z].tobytes(), name[a:z].tobytes()) for a, z in zip(heads, [*heads[1:], len(bucket)])]
                if pieces:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*pieces), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "marks", "nodes"])

    def meet(batches):
        import pyarrow as pa

        held, at = ([], []), None

        def done():
            if at is None:
                return
            mark, node = (np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<u4", "<i8")))
            order = np.argsort(mark, kind="stable")
            mark, node = mark[order], node[order]
            heads = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            several = np.minimum.reduceat(node, heads) != np.maximum.reduceat(node, heads)
            keep = np.repeat(several, np.diff(np.append(heads, len(mark))))
            node, mark = node[keep], mark[keep]
            target = node % buckets
            order = np.lexsort((node, target))
            node, mark, target = node[order], mark[order], target[order]
            if len(node):
                heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                counts, name, at_ = np.diff(np.append(heads, len(node))), node[heads], target[heads]
                first = np.flatnonzero(np.concatenate([[True], at_[1:] != at_[:-1]]))
                out = []
                for a, z in zip(first, [*first[1:], len(heads)]):
                    end = heads[z] if z < len(heads) else len(mark)
                    out.append((int(at_[a]), _blob(name[a:z], "<i8"), _blob(counts[a:z], "<u4"), _blob(mark[heads[a] : end], "<u4")))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], names=["target", "nodes", "counts", "marks"])

        for b in batches:
            for bucket, *blobs in zip(*(b.column(k).to_pylist() for k in range(3))):
                if bucket != at:
                    yield from done()
                    held, at = ([], []), bucket
                for x, y in zip(held, blobs):
                    x.append(y)
        yield from done()

    dealt = dealt_out(rows.mapInArrow(trimmed(cut), "bucket int, marks binary, nodes binary"), buckets, "bucket")
    return dealt.mapInArrow(trimmed(meet), "target int, nodes binary, counts binary, marks binary")


def candidates(rows: DataFrame, marks: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """kind 0: windows around shared anchors, packed by bucket (place: the bucket); kind 1: each text that has any, once,
    packed by target (place: the target, sizes: those of the texts). Packed: nodes, twins, docs, counts (windows of each
    text), starts, sizes, marks and compressed data.

    rows: node, twin, doc, text; two hashes name a text. A task that meets a text again sends its document's number only.
    """

    def once(batches):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for b in batches:
            nodes, twins, texts = (b.column(k).to_pylist() for k in (0, 1, 3))
            sent = []
            for name, text in zip(zip(nodes, twins), texts):
                sent.append(None if name in seen else text)
                seen.add(name)
            if len(seen) > 500_000:
                seen = set()
            none = pa.nulls(b.num_rows, pa.binary())
            target = pa.array(np.array(nodes, np.int64) % buckets, pa.int32())
            yield pa.record_batch([target, b.column(0), b.column(1), b.column(2), pa.array(sent, pa.binary()), none, none, none], names=["target", "node", "twin", "doc", "text", "nodes", "counts", "marks"])

    def join(batches):
        import pyarrow as pa

        ready: list[tuple] = []
        held, shared, at, target, size = {}, {}, None, None, 0

        def flush():
            text, first, count, _, hashes = anchors([x[3] for x in ready], length, gram)
            bucket, mark = bucket_of(hashes, buckets), mark_of(hashes)
            bounds = np.searchsorted(text, np.arange(len(ready) + 1))
            used = [b + np.flatnonzero(np.isin(mark[b:e], x[4])) for b, e, x in zip(bounds, bounds[1:], ready)]
            whole = [k for k, x in enumerate(used) if len(x)]
            if not whole:
                return
            names = [np.array([x[c] for x in ready], np.int64) for c in range(3)]
            lengths = [len(ready[k][3]) for k in whole]
            out = [(1, target, *(_blob(x[whole], "<i8") for x in names), None, None, _blob(lengths, "<u4"), None, pressed(b"".join(ready[k][3] for k in whole)))]
            use = np.concatenate(used)
            use = use[np.argsort(bucket[use], kind="stable")]
            heads = np.flatnonzero(np.concatenate([[True], bucket[use][1:] != bucket[use][:-1]]))
            for here in np.split(use, heads[1:]):
                begin, n, of = first[here], count[here] + length - 1, text[here]
                some, counts = np.unique(of, return_counts=True)
                pieces = b"".join(ready[k][3][p : p + q] for k, p, q in zip(of.tolist(), begin.tolist(), n.tolist()))
                out.append((0, int(bucket[here[0]]), *(_blob(x[some], "<i8") for x in names), _blob(counts, "<u4"), _blob(begin, "<u4"), _blob(n, "<u4"), _blob(mark[here], "<u4"), pressed(pieces)))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 8)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["kind", "place", "nodes", "twins", "docs", "counts", "starts", "sizes", "marks", "data"])

        def add():
            nonlocal size
            found = shared.get(at)
            for (node, twin), (doc, text) in held.items() if found else ():
                ready.append((node, twin, doc, text, np.concatenate(found)))
                size += len(text)

        for b in batches:
            for to, node, twin, doc, text, *packed in zip(*(b.column(k).to_pylist() for k in range(8))):
                if node != at or to != target:
                    add()
                    held, at = {}, node
                if size > 4_000_000 or to != target and ready:
                    yield from flush()
                    ready, size = [], 0
                if to != target:
                    shared, target = {}, to
                if node is None:
                    names, counts, marks = (np.frombuffer(x, t) for x, t in zip(packed, ("<i8", "<u4", "<u4")))
                    for name, some in zip(names.tolist(), _parts(marks, counts)):
                        shared.setdefault(name, []).append(some)
                    continue
                low, kept = held.get((node, twin), (doc, text))
                held[node, twin] = (min(low, doc), kept if kept is not None else text)
        add()
        if ready:
            yield from flush()

    schema = "target int, node long, twin long, doc long, text binary, nodes binary, counts binary, marks binary"
    packed = marks.selectExpr("target", "cast(null as long) node", "cast(null as long) twin", "cast(null as long) doc", "cast(null as binary) text", "nodes", "counts", "marks")
    all_ = rows.mapInArrow(trimmed(once), schema).unionByName(packed).repartition(min(buckets, TASKS), "target")
    windows = "kind int, place int, nodes binary, twins binary, docs binary, counts binary, starts binary, sizes binary, marks binary, data binary"
    return all_.sortWithinPartitions("target", F.col("node").asc_nulls_first()).mapInArrow(trimmed(join), windows)


class Bucket:
    """The distinct strings of a bucket, each with its smallest document and anchor, and the places where texts have them."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.lowest, self.anchor = array("q"), array("I")
        self.nodes, self.twins, self.docs = array("q"), array("q"), array("q")
        self.text, self.string, self.start = array("I"), array("I"), array("I")

    def add(self, node: int, twin: int, doc: int, starts: np.ndarray, sizes: np.ndarray, marks: np.ndarray, data: bytes) -> None:
        begin, number = 0, len(self.nodes)
        self.nodes.append(node)
        self.twins.append(twin)
        self.docs.append(doc)
        for start, n, mark in zip(starts.tolist(), sizes.tolist(), marks.tolist()):
            k = self.index.setdefault(data[begin : begin + n], len(self.lowest))
            begin += n
            if k == len(self.lowest):
                self.lowest.append(doc)
                self.anchor.append(mark)
            elif doc < self.lowest[k]:
                self.lowest[k] = doc
            self.text.append(number)
            self.string.append(k)
            self.start.append(start)

    def spans(self, length: int) -> dict[int, array]:
        """What smaller documents' windows cover of each text, by its number: pairs of start and end."""
        strings, lowest = list(self.index), np.array(self.lowest, np.int64)
        self.index = {}
        _, group, size = np.unique(np.array(self.anchor), return_inverse=True, return_counts=True)
        several = np.flatnonzero(size[group] > 1)
        low, high, first = lowest.copy(), lowest.copy(), np.full(len(strings), -1)
        if len(several):
            least, begin = equal_windows([strings[k] for k in several], lowest[several], length)
            low[several], high[several], first[several] = np.minimum.reduceat(least, begin), np.maximum.reduceat(least, begin), begin
        sizes = [len(x) for x in strings]
        del strings
        low, high, first = low.tolist(), high.tolist(), first.tolist()
        spans: dict[int, array] = {}
        for number, k, start in zip(self.text, self.string, self.start):
            doc = self.docs[number]
            if high[k] < doc:
                spans.setdefault(number, array("I")).extend((start, start + sizes[k]))
            elif low[k] < doc:
                gone = np.concatenate([[False], least[first[k] : first[k] + sizes[k] - length + 1] < doc, [False]])
                edge = np.flatnonzero(gone[1:] != gone[:-1])
                for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    spans.setdefault(number, array("I")).extend((start + a, start + z + length - 1))
        return spans


def removals(found: DataFrame, buckets: int, length: int) -> DataFrame:
    """What windows of smaller documents cover, from kind 0 of candidates, packed: target (part of the texts), nodes,
    twins, counts and spans (pairs of start and end), a row for each bucket and target and not for each text.

    Equal strings of a bucket are one; one whose anchor no other string has can share windows with nothing else, so that
    all of its windows are in the same documents. All others are sorted.
    """

    def sort(batches):
        import pyarrow as pa

        held, at = Bucket(), None

        def done():
            if at is None:
                return
            spans = held.spans(length)
            targets: dict[int, list[int]] = {}
            for number in spans:
                targets.setdefault(held.nodes[number] % buckets, []).append(number)
            if targets:
                out = [(t, _blob([held.nodes[x] for x in some], "<i8"), _blob([held.twins[x] for x in some], "<i8"), _blob([len(spans[x]) for x in some], "<u4"), _blob([y for x in some for y in spans[x]], "<u4")) for t, some in targets.items()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names=["target", "nodes", "twins", "counts", "spans"])

        for b in batches:
            for bucket, *row in zip(*(b.column(k).to_pylist() for k in range(9))):
                if bucket != at:
                    yield from done()
                    held, at = Bucket(), bucket
                for one in unpacked(*row):
                    held.add(*one)
        yield from done()

    found = found.where("kind = 0").select(F.col("place").alias("bucket"), "nodes", "twins", "docs", "counts", "starts", "sizes", "marks", "data")
    return dealt_out(found, buckets, "bucket").mapInArrow(trimmed(sort), "target int, nodes binary, twins binary, counts binary, spans binary")


def kept_spans(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The maximal removed runs of a union of spans."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(map(tuple, spans.reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def bucket_count(df: DataFrame, text_col: str = "text") -> int:
    """Buckets of about BUCKET bytes of what the files hold, or of the texts where Spark doesn't know their size; small
    ones cost more, as induction goes by steps. Their number grows with the input; that of tasks ends at TASKS."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4, min(-(-size // BUCKET), (1 << 31) - 1))


def dealt_out(df: DataFrame, buckets: int, key: str, *order: Column) -> DataFrame:
    """Rows of a bucket in one task and next to each other."""
    return df.repartition(min(buckets, TASKS), key).sortWithinPartitions(key, *order)


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array<struct<start, end>>: maximal removed runs of bytes) and
    kept_sha256 (of the bytes that stay, in lowercase hex).

    A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id; matches
    never cross documents and all are judged on the input. Two 64-bit hashes name a text. Null text: empty. A null id: nothing is removed, and the row
    is no reason to remove anything. Equal ids: not smaller than one another, so neither removes from the other; equal
    texts are told apart by id. Other columns are ignored. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    buckets = bucket_count(df, text_col)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    names = {"node": F.xxhash64("text"), "twin": F.xxhash64(F.lit(1), F.octet_length("text"), "text")}
    named = docs.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).withColumns(names)
    marks, first = materialize(shared_anchors(named.select("node", "text"), buckets, length, gram), "anchors")
    found, second = materialize(candidates(named.select("node", "twin", "doc", "text"), marks, buckets, length, gram), "windows")
    gone, third = materialize(removals(found, buckets, length), "spans")

    def apply(batches):
        import pyarrow as pa

        spans, at = {}, None
        for b in batches:
            out: list[tuple] = []
            for target, data, sizes, nodes, twins, *packed in zip(*(b.column(k).to_pylist() for k in range(7))):
                if target != at:
                    spans, at = {}, target
                names = [*zip(*(np.frombuffer(x, "<i8").tolist() for x in (nodes, twins)))]
                if data is None:
                    counts, values = (np.frombuffer(x, "<u4") for x in packed)
                    for name, part in zip(names, _parts(values, counts)):
                        spans.setdefault(name, []).append(part)
                    continue
                size = np.frombuffer(sizes, "<u4").astype(np.int64)
                text = memoryview(pa.decompress(data, decompressed_size=int(size.sum()), codec="zstd", asbytes=True))
                for (node, twin), z, n in zip(names, np.cumsum(size).tolist(), size.tolist()):
                    mine = spans.pop((node, twin), None)
                    if mine is None:
                        continue
                    kept, digest, begin = kept_spans(np.concatenate(mine), n), hashlib.sha256(), z - n
                    for first_, last_ in kept:
                        digest.update(text[begin : z - n + first_])
                        begin = z - n + last_
                    digest.update(text[begin:z])
                    out.append((node, twin, [{"start": x, "end": y} for x, y in kept], digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["node", "twin", "spans", "kept"])

    none = F.lit(None).cast("binary")
    text_rows = found.where("kind = 1").select(F.col("place").alias("target"), "data", "sizes", "nodes", "twins", none.alias("counts"), none.alias("spans"))
    span_rows = gone.select("target", none.alias("data"), none.alias("sizes"), "nodes", "twins", "counts", "spans")
    both = dealt_out(span_rows.unionByName(text_rows), buckets, "target", F.col("data").isNotNull())
    marked = both.mapInArrow(trimmed(apply), "node long, twin long, spans array<struct<start:bigint,end:bigint>>, kept string")
    marked, fourth = materialize(marked, "marked")
    low = named.groupBy("node", "twin").agg(F.min("doc").alias("low"))
    known = low.join(marked, ["node", "twin"], "left")
    digest = docs.withColumns(names).select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), "node", "twin")
    joined = digest.join(known, ["node", "twin"], "left")
    copy = F.col("doc").isNotNull() & (F.col("n_bytes") >= length) & (F.col("doc") > F.col("low"))
    own = F.col("doc").isNotNull() & (F.col("doc") == F.col("low")) & F.col("spans").isNotNull()
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = joined.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).when(own, F.col("spans")).otherwise(none).alias("spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(own, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    out, _ = materialize(out, "repeats")
    discard(spark, first, second, third, fourth)
    return out


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents when 50-byte strings of smaller documents go."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE low < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM g)) GROUP BY doc_id, k),
p AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS runs FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, n, h, coalesce(gone, 0) AS gone, coalesce(runs, 0) AS runs, list_concat([0], coalesce(z, [])) AS b, list_concat(coalesce(a, []), [n]) AS e FROM d LEFT JOIN p USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, gone AS n_removed, runs AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(b) + 1), lambda x: substr(h, 2 * b[x] + 1, 2 * (e[x] - b[x]))), ''))) AS kept_sha256
FROM k
"""
