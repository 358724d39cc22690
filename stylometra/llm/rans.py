"""Static range asymmetric numeral system for token ids: interleaved blocks with checkpoints and checksums.

A block is coded by `lanes` interleaved 64-bit states with 32-bit renormalisation. Token i belongs to step
i // lanes and lane i % lanes. Every CHECKPOINT steps the block stores all states and the position in its words, so
that parts of a block can be decoded on their own. Layout: HEADER, first states, checkpoints, words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, VERSION, SCALE, CHECKPOINT, LANES = b"SRNS", 1, 20, 64, 1024
LOW = np.uint64(1 << 31)
#: magic, version, scale, lanes, tokens, words, steps between checkpoints, checkpoints, crc of the table, of the ids, of all that follows
HEADER = struct.Struct("<4sBBHQQIIIII")


class Table:
    """Frequencies that sum to 2**SCALE; each id that occurs has one at least. It depends on the counts only."""

    def __init__(self, counts: np.ndarray):
        counts = np.trim_zeros(np.asarray(counts, dtype=np.int64), "b")
        used = counts > 0
        if used.sum() > 1 << SCALE:
            raise ValueError("more distinct ids than 2**SCALE")
        share = np.zeros(len(counts), dtype=np.int64)
        if used.any():
            share[used] = np.maximum(1, (counts[used].astype(object) * (1 << SCALE) // int(counts.sum())).astype(np.int64))
            left = (1 << SCALE) - int(share.sum())
            order = np.argsort(-share, kind="stable")
            k = 0
            while left:
                i = order[k]
                step = left if left > 0 else max(left, 1 - int(share[i]))
                share[i] += step
                left, k = left - step, k + 1
        self.freq = share.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64) if len(share) else self.freq
        self.crc = zlib.crc32(share.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 16))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    marks: dict[int, np.ndarray] = {}
    freq, first = table.freq[ids], table.first[ids]
    if n and not freq.all():
        raise ValueError("an id without a frequency")
    shift, half, scale = np.uint64(63 - SCALE), np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], first[t * lanes : (t + 1) * lanes]
        y = x[: len(f)]
        big = y >= (f << shift)
        if big.any():
            words[t] = (y[big] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            y = np.where(big, y >> half, y)
        q = y // f
        x[: len(f)] = (q << scale) + (y - q * f) + c
        if t and t % CHECKPOINT == 0:
            marks[t] = x.copy()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    body = [x.astype("<u8").tobytes()]
    for t in sorted(marks):
        body += [struct.pack("<IQ", t, int(at[t])), marks[t].astype("<u8").tobytes()]
    body += [w.astype("<u4").tobytes() for w in words]
    payload = b"".join(body)
    return HEADER.pack(MAGIC, VERSION, SCALE, lanes, n, int(at[-1]), CHECKPOINT, len(marks), table.crc, zlib.crc32(np.asarray(ids).astype("<u4").tobytes()), zlib.crc32(payload)) + payload


def _opened(block: bytes, table: Table):
    magic, version, scale, lanes, n, n_words, every, n_marks, table_crc, ids_crc, crc = HEADER.unpack_from(block)
    if (magic, version, scale) != (MAGIC, VERSION, SCALE) or table_crc != table.crc:
        raise ValueError("not a block of this table")
    if zlib.crc32(memoryview(block)[HEADER.size :]) != crc:
        raise ValueError("a block's checksum is wrong")
    at = HEADER.size
    marks = {0: (0, np.frombuffer(block, "<u8", lanes, at))}
    at += 8 * lanes
    for _ in range(n_marks):
        t, pos = struct.unpack_from("<IQ", block, at)
        marks[t] = (pos, np.frombuffer(block, "<u8", lanes, at + 12))
        at += 12 + 8 * lanes
    return lanes, n, ids_crc, marks, np.frombuffer(block, "<u4", n_words, at)


def parts(block: bytes, table: Table) -> list[int]:
    """The steps at which decode_part can begin."""
    return sorted(_opened(block, table)[3])


def decode_part(block: bytes, table: Table, begin: int, opened=None) -> np.ndarray:
    """The ids from a checkpoint to the next one or the end."""
    lanes, n, _, marks, words = opened or _opened(block, table)
    steps = -(-n // lanes)
    end = min([t for t in marks if t > begin], default=steps)
    pos, x = marks[begin][0], marks[begin][1].astype(np.uint64)
    out = np.empty(min(end * lanes, n) - begin * lanes, dtype=np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(begin, end):
        m = min(lanes, n - t * lanes)
        y = x[:m]
        slot = y & mask
        s = table.symbol[slot]
        y = table.freq[s] * (y >> scale) + slot - table.first[s]
        low = y < LOW
        k = int(np.count_nonzero(low))
        if k:
            y[low] = (y[low] << half) | words[pos : pos + k].astype(np.uint64)
            pos += k
        x[:m] = y
        out[(t - begin) * lanes : (t - begin) * lanes + m] = s
    return out


def decode(block: bytes, table: Table) -> np.ndarray:
    opened = _opened(block, table)
    out = [decode_part(block, table, t, opened) for t in sorted(opened[3])] if opened[1] else []
    ids = np.concatenate(out) if out else np.empty(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != opened[2]:
        raise ValueError("the decoded ids' checksum is wrong")
    return ids


def blocks(documents: Iterator[tuple[int | None, bytes]], table: Table, size: int, kind: str = "<u4") -> Iterator[tuple[int, list, list[int], bytes]]:
    """kind: the type of the documents' ids. Blocks of whole documents with at least `size` ids but for the last: first id's place, doc_ids, lengths, block."""
    first, names, held, total, each = 0, [], [], 0, np.dtype(kind).itemsize
    for name, ids in documents:
        names.append(name)
        held.append(ids)
        total += len(ids) // each
        if total >= size:
            yield first, names, [len(x) // each for x in held], encode(np.frombuffer(b"".join(held), kind), table)
            first, names, held, total = first + total, [], [], 0
    if names:
        yield first, names, [len(x) // each for x in held], encode(np.frombuffer(b"".join(held), kind), table)
