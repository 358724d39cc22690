"""External induced sorting of suffixes with common-prefix values.

Suffixes are induced from the sorted leftmost S-type ones, whose order comes from the recursion on their names. The
queues of the buckets are ranges of one array, filled in order, so that taking the next suffix is a scan; arrays beyond
MEMORY bytes are files, mapped into memory, in Spark's own spill folders, and are gone with their last use. The scan
takes as many rows at once as can't be followed by a suffix that they themselves induce, so each step is a vector
operation. With every suffix goes the length of its common prefix with the one before it, cut at `cap` and at separators:
an induced pair has one more than the least value between its two inducers. The recursion carries these lengths too, so
that two leftmost S-type suffixes are compared only beyond the names they share.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MEMORY = 256 << 20
NONE = 255


def room(n: int, dtype, value) -> np.ndarray:
    """An array, on disk if it is large."""
    size = n * np.dtype(dtype).itemsize
    if size <= MEMORY:
        return np.full(n, value, dtype)
    where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=where if where and os.path.isdir(where) else None) as f:
        f.truncate(size)
        out = np.memmap(f, dtype, "r+", shape=(n,))
    for a in range(0, n, 1 << 22):
        out[a : a + (1 << 22)] = value
    return out


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    edge = np.empty(len(values), bool)
    edge[:1] = True
    np.not_equal(values[1:], values[:-1], out=edge[1:])
    return edge.nonzero()[0]


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(heads), np.int64)
    np.subtract(heads[1:], heads[:-1], out=out[:-1])
    out[-1:] = n - heads[-1:]
    return out


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[begin:end] for each pair; NONE where that is empty."""
    out = np.full(len(begin), NONE, np.uint8)
    length = end - begin
    longest = int(length.max()) if len(length) else 0
    table, width = values, 1
    while width <= longest:
        here = ((length >= width) & (length < 2 * width)).nonzero()[0]
        if len(here):
            out[here] = np.minimum(table[begin[here]], table[end[here] - width])
        if 2 * width > longest:
            break
        table, width = np.minimum(table[: len(table) - width], table[width:]), 2 * width
    return out


def _scan(text: np.ndarray, wanted: np.ndarray, rows: np.ndarray, free: np.ndarray, common=None, seams=None, cap: int = 0, begun=None) -> None:
    """Induce the suffixes of the wanted type from rows, in their order; free: the next place of each bucket.

    A step that reaches a row it would fill itself is cut there; what it found before stays, as each symbol's rows are
    in order.

    common: common prefix of each row with the one before; seams: (row, bucket) of rows whose value must be found from
    the bucket's last induced row, in order of row; begun: the first place of each bucket.
    """
    n, r, m = len(rows), 0, 512
    if common is not None:
        least = np.full(len(free), NONE, np.uint8)
        next_seam = 0
    while r < n:
        m = min(2 * m, n - r, 1 << 18)
        here = rows[r : r + m]
        at = (here > 0).nonzero()[0]
        before = here[at] - 1
        fit = wanted[before].nonzero()[0]
        at, before = at[fit], before[fit]
        symbol = text[before]
        order = symbol.argsort(kind="stable")
        symbol, at, before = symbol[order], at[order], before[order]
        heads = _heads(symbol)
        sizes = _sizes(heads, len(symbol))
        lead = symbol[heads]
        place = np.arange(len(symbol)) + (free[lead] - heads).repeat(sizes)
        limit = int(place.min()) - r if len(place) else m
        if limit < m:
            m = limit
            keep = (at < m).nonzero()[0]
            symbol, at, before, place = symbol[keep], at[keep], before[keep], place[keep]
            heads = _heads(symbol)
            sizes = _sizes(heads, len(symbol))
            lead = symbol[heads]
        rows[place] = before
        if common is not None:
            while next_seam < len(seams) and seams[next_seam][0] < r + m:
                row, bucket = seams[next_seam]
                common[row] = _compare(text, int(rows[row]), int(rows[free[bucket] - 1]), cap) if free[bucket] > begun[bucket] and bucket else 0
                next_seam += 1
            values = np.asarray(common[r : r + m])
            if len(heads):
                k = len(at)
                begin, end = np.empty(k + len(heads), np.int64), np.empty(k + len(heads), np.int64)
                np.add(at, 1, out=end[:k])
                begin[1:k] = end[: k - 1]
                begin[heads] = 0
                begin[k:] = end[heads + sizes - 1]
                end[k:] = m
                both = _least(values, begin, end)
                found = both[:k]
                found[heads] = np.minimum(found[heads], least[lead])
                found = np.minimum(found, min(cap, NONE - 1) - 1) + np.uint8(1)
                found[heads[free[lead] == begun[lead]]] = 0
                found[symbol == 0] = 0
                common[place] = found
                np.minimum(least, values.min(), out=least)
                least[lead] = both[k:]
            else:
                np.minimum(least, values.min(), out=least)
        free[lead] += sizes
        r += m


def _compare(text: np.ndarray, i: int, j: int, cap: int) -> int:
    a, b = text[i : i + cap], text[j : j + cap]
    n = min(len(a), len(b))
    stop = np.flatnonzero((a[:n] != b[:n]) | (a[:n] == 0))
    return int(stop[0]) if len(stop) else n


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the last is L-type."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    step = np.empty(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n, dtype=kind), kind(n))
    known = np.minimum.accumulate(known[::-1])[::-1]
    return step[known] > 0


def _named(text: np.ndarray, small: np.ndarray, order: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost S-type substrings by their sorted order; equal ones share a name."""
    n = len(text)
    end = np.append(lms[1:], n)
    kind = np.int32 if n < 1 << 31 else np.int64
    at = np.empty(n + 1, kind) if n < MEMORY // 8 else room(n + 1, kind, 0)
    at[lms] = np.arange(len(lms), dtype=kind)
    k = at[order]
    length = end[k] - lms[k]
    same = length[1:] == length[:-1]
    same &= (end[k][1:] < n) & (end[k][:-1] < n)
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        i, j = order[left], order[left + 1]
        done = step > length[left]
        equal = done | (text[np.minimum(i + step, n - 1)] == text[np.minimum(j + step, n - 1)])
        same[left[~equal]] = False
        left = left[equal & ~done]
        step += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(lms), np.int64)
    out[k] = name
    return out, int(name[-1]) + 1


def sorted_suffixes(text: np.ndarray, cap: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The starts of text's suffixes in descending order, and with cap the common prefix of each with the one before.

    text: integers, 0 at the end and between strings. Values are at most min(cap, 254) and never reach over a 0.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint8) if cap else None
    sigma = int(text.max()) + 1
    small = _types(text)
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    begins = np.concatenate([[0], ends[:-1]])
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, carried = lms, None
    if len(lms) > 1:
        rows = _induced(text, small, begins, ends, lms[np.argsort(text[lms], kind="stable")])[0][::-1]
        star = np.zeros(n, bool)
        star[lms] = True
        order = np.concatenate([r[star[r]] for r in (np.asarray(rows[a : a + (1 << 22)]) for a in range(0, n, 1 << 22))])
        names, count = _named(text, small, order, lms)
        if count < len(lms):
            # names are at least two symbols apart; 1 is added as 0 would part them
            below, shared = sorted_suffixes(names + 1, min(cap, NONE - 1) // 2 + 1 if cap else 0)
            order = lms[below[::-1]]
            if cap:
                carried = _carried(text, lms, np.asarray(below)[::-1], np.asarray(shared)[::-1], cap)
    return _induced(text, small, begins, ends, order, cap, carried)


def _carried(text: np.ndarray, lms: np.ndarray, rank: np.ndarray, shared: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that each leftmost S-type suffix, in ascending order, shares with the one before at least: those of the
    names that the recursion found in common, cut at separators and at cap."""
    out = np.zeros(len(rank), np.uint8)
    common = np.minimum(shared[:-1].astype(np.int64), np.minimum(len(lms) - 1 - rank[1:], len(lms) - 1 - rank[:-1]))
    width = lms[rank[1:] + common] - lms[rank[1:]]
    zeros = np.append(np.flatnonzero(text == 0), len(text))
    room_left = zeros[np.searchsorted(zeros, lms[rank[1:]])] - lms[rank[1:]]
    out[1:] = np.minimum(np.minimum(width, room_left), cap)
    return out


def _induced(text, small, begins, ends, order, cap: int = 0, carried=None):
    """Place leftmost S-type suffixes in this order, induce all others; rows come out descending."""
    n = len(text)
    rows = room(n, np.int32 if n < 1 << 31 else np.int64, -1)
    common = room(n, np.uint8, NONE) if cap else None
    head = text[order]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(order) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(order)))
    place = np.repeat(ends[head[first]] - sizes, sizes) + np.arange(len(order)) - np.repeat(first, sizes) if len(order) else order
    rows[place] = order
    seams = None
    if cap:
        value = np.zeros(len(order), np.uint8) if carried is None else carried
        left = np.flatnonzero((head[1:] == head[:-1]) & (head[1:] > 0)) + 1
        left = left[value[left] < cap]
        while len(left):
            i, j = order[left] + value[left], order[left - 1] + value[left]
            equal = (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)]) & (text[np.minimum(i, n - 1)] > 0) & (i < n) & (j < n)
            left = left[equal]
            value[left] += 1
            left = left[value[left] < cap]
        common[place] = value
        seams = [(int(place[f]), int(head[f])) for f in first]
    free = begins.copy()
    last = text[n - 1]
    rows[free[last]] = n - 1
    if cap:
        common[free[last]] = 0
    start = free.copy()
    free[last] += 1
    _scan(text, ~small, rows, free, common, seams, cap, start)
    large_end = free
    down = rows[::-1]
    for a in range(0, n, 1 << 22):
        here = np.asarray(rows[a : a + (1 << 22)])
        keep = here >= 0
        keep[keep] = ~small[here[keep]]
        rows[a : a + (1 << 22)] = np.where(keep, here, -1)
    mirrored = None
    if cap:
        mirrored = room(n, np.uint8, NONE)
        many = np.flatnonzero(large_end > begins)
        # the value between rows i and i + 1 belongs to row i when the order is turned
        mirrored[1:] = common[1:][::-1]
        keep = rows[::-1] >= 0
        mirrored[~keep] = NONE
        seams = sorted((int(n - large_end[c]), int(c)) for c in many)
    _scan(text, small, down, n - ends, mirrored, seams, cap, n - ends)
    return down, mirrored

