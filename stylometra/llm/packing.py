"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens (dot-product heuristic)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, vocabulary
from .shared import grouped, prepare, table, trimmed

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


@dataclass(frozen=True)
class Limits:
    """What one training sequence may hold at most."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


class Packer:
    """Fills one sequence after the other from a pool of examples.

    An example is a range [start, end) of its document; tokens at loss_from and later bear loss. Examples of equal
    demand (tokens, loss-bearing tokens) form one class. The class that fits and has the largest dot product of its
    demand with the sequence's free capacity, both relative to the limits, goes next; ties: the class seen first.
    If none fits whole, the longest is cut to what fits. Short stay the last sequence of all and those that another
    limit closes; these are split at powers of two, which need no padding.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.rows: dict[tuple[int, int], int] = {}
        self.items: list[list[tuple[int, int, int, int]]] = []
        self.demand = np.zeros((64, 2))
        self.there = np.zeros(64, dtype=bool)
        self.whole: list[tuple[int, int, int, int]] = []
        self.used, self.segments, self.loss = 0, 0, 0
        self.placed: list[tuple[int, int, int, int]] = []

    def _loss(self, start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def add(self, doc: int, start: int, end: int, loss_from: int) -> None:
        """Put an example into the pool; what fills whole sequences by itself is cut off at once."""
        while (n := min(self.limits.tokens, max(0, loss_from - start) + self.limits.loss_tokens)) <= end - start and n:
            self.whole.append((doc, start, start + n, 0))
            start += n
        if end == start:
            return
        key = (end - start, self._loss(start, end, loss_from))
        row = self.rows.setdefault(key, len(self.items))
        if row == len(self.items):
            self.items.append([])
            if row == len(self.there):
                self.demand, self.there = np.concatenate([self.demand, self.demand]), np.concatenate([self.there, np.zeros(row, dtype=bool)])
            self.demand[row] = key
        self.items[row].append((doc, start, end, loss_from))
        self.there[row] = True

    def _take(self, row: int) -> tuple[int, int, int, int]:
        item = self.items[row].pop()
        self.there[row] = bool(self.items[row])
        return item

    def _place(self, doc: int, start: int, end: int, loss_from: int) -> None:
        self.placed.append((doc, start, end, self.used))
        self.used += end - start
        self.segments += 1
        self.loss += self._loss(start, end, loss_from)

    def fill(self, last: bool) -> Iterator[list[tuple[int, int, int, int]]]:
        """Sequences of (document, start, end, offset); what is in an unfilled one stays placed, unless it is the last."""
        most = self.limits
        while True:
            while self.whole:
                yield [self.whole.pop()]
            free = (most.tokens - self.used, most.segments - self.segments, most.loss_tokens - self.loss)
            if not free[0] or not free[1]:
                yield self._close()
                continue
            there = self.there[: len(self.items)]
            if not there.any():
                break
            demand = self.demand[: len(self.items)]
            fits = there & (demand[:, 0] <= free[0]) & (demand[:, 1] <= free[2])
            dot = demand[:, 0] * (free[0] / most.tokens**2) + demand[:, 1] * (free[2] / most.loss_tokens**2) + free[1] / most.segments**2
            best = int(np.argmax(np.where(fits, dot, -1.0)))
            if fits[best]:
                self._place(*self._take(best))
                continue
            doc, start, end, loss_from = self._take(int(np.argmax(np.where(there, demand[:, 0], -1.0))))
            room = min(end - start, free[0], max(0, loss_from - start) + free[2])
            if room:
                self._place(doc, start, start + room, loss_from)
            self.add(doc, start + room, end, loss_from)
            if not room:
                yield self._close()
        self.rows, self.items = {}, []
        if self.placed and last:
            yield self._close()

    def _close(self) -> list[tuple[int, int, int, int]]:
        out, self.placed = self.placed, []
        self.used = self.segments = self.loss = 0
        return out

    def reopen(self, loss_from: dict[int, int]) -> None:
        for doc, start, end, _ in self._close():
            self.add(doc, start, end, loss_from[doc])


def powers(sequence: list[tuple[int, int, int, int]], whole: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """A short sequence as sequences whose lengths are powers of two."""
    total = sequence[-1][3] + sequence[-1][2] - sequence[-1][1]
    if total == whole:
        yield sequence
        return
    rest, out, room = [(d, s, e) for d, s, e, _ in sequence], [], 1 << (total.bit_length() - 1)
    used = 0
    while rest:
        doc, start, end = rest.pop(0)
        n = min(end - start, room - used)
        out.append((doc, start, start + n, used))
        used, total = used + n, total - n
        if start + n < end:
            rest.insert(0, (doc, start + n, end))
        if used == room:
            yield out
            out, used, room = [], 0, 1 << max(0, total.bit_length() - 1)


def pack(df: DataFrame, limits: Limits, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, loss_from: Column | None = None, pool_tokens: int = 4_000_000) -> DataFrame:
    """Pack the texts of df into sequences: one row per piece, with its ids as little-endian unsigned 32-bit bytes.

    A document is its text's ids, then end_id. loss_from: number of leading tokens of a row that bear no loss (default:
    1, the first token of a document has no context). Each partition packs its own rows in pools of about pool_tokens
    tokens: no shuffle, bounded memory, and a lost task gives the same rows again. sequence_id is partition << 32 + running number.

    Null text: empty, so only end_id (no piece without end_id). Repeated rows and ties: each row is packed for itself.
    A null id stays null. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    prepare(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path)
        ending = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        base, count = TaskContext.get().partitionId() << 32, 0
        packer, docs, names, from_, held, key = Packer(limits), {}, {}, {}, 0, 0

        def rows(sequences):
            nonlocal count
            out, size = [], 0
            for sequence in sequences:
                for short in powers(sequence, limits.tokens):
                    for doc, start, end, offset in short:
                        out.append((names[doc], start, end - start, len(docs[doc]) // 4, base + count, offset, max(0, end - max(start, from_[doc])), docs[doc][4 * start : 4 * end]))
                        size += end - start
                    count += 1
                if size >= 1_000_000:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

        def batch(out):
            columns = list(zip(*out))
            return pa.record_batch([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            ids, texts, begins = (b.column(k).to_pylist() for k in range(3))
            for group in grouped([*zip(ids, texts, begins)], [len(t or "") for t in texts], 4_000_000):
                for (name, _, begin), found in zip(group, encode.many([g[1] for g in group])):
                    docs[key], names[key], from_[key] = found + ending, name, begin or 0
                    n = len(docs[key]) // 4
                    packer.add(key, 0, n, from_[key])
                    key, held = key + 1, held + n
                if held >= pool_tokens:
                    yield from rows(packer.fill(False))
                    open_ = {p[0] for p in packer.placed}
                    packer.reopen(from_)
                    docs, names, from_ = ({k: x[k] for k in open_} for x in (docs, names, from_))
                    held = sum(len(x) // 4 for x in docs.values())
        yield from rows(packer.fill(True))

    begin = F.lit(1).cast("long") if loss_from is None else loss_from.cast("long")
    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), begin.alias("l")).mapInArrow(trimmed(run), SCHEMA)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; one row per piece."""
    packed = pack(table(spark, sf_dir, "documents"), Limits(), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
