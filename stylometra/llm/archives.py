"""Web archives: WARC files of captures, read back into sorted runs, and an index of the runs merged by loser trees.

Archives are written by Spark's own text writer, whose separator is the blank lines that end a record; so task commits,
retries and file systems are Spark's. Files are compressed as a whole and hold a bounded number of bytes, and are read
as streams. Every reading task sorts its captures into runs of a bounded size. Runs are merged in rounds of a bounded
fan-in until few are left; these are cut at splitters of the whole key (URL key, time, id, place), so that a URL with
very many captures is spread as well, and every range is merged on its own. Ranges are numbered in order, so positions
in the whole index follow from one count for each range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, partitions, prepare, shared_dir, table, trimmed

END = "\r\n\r\n"
#: bytes of an archive file before compression, captures of a run and of a block, runs that are merged at once
FILE_BYTES, RUN, BLOCK, FAN_IN = 16 << 20, 1 << 17, 1024, 256
#: bytes of records that leave a writing task at once
WRITE_BATCH = 4 << 20
#: keys that splitters of the last merge are chosen from; they decide how even the ranges are, never what is in them
SPLITTER_SAMPLE = 20_000
#: payloads shorter than this are always written in full
LEAST_BYTES = 100
#: groups of equal payloads up to which their first captures are broadcast
FEW_GROUPS = 100_000
ENTRY = "url_key string, captured string, page_id long, place string, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
FIELDS = [c.split()[0] for c in ENTRY.split(", ")]
BLOCK_SCHEMA = f"run long, grp long, first binary, entries array<struct<{', '.join(c.replace(' ', ':') for c in ENTRY.split(', '))}>>"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host in reversed order, then port, path and the query's parts in order; case, www. and fragment don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, 80, 443) else f":{port}"
    path = re.sub(r"/+", "/", parts.path.lower()).rstrip("/") or "/"
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + path + (f"?{query}" if query else "")


def order_of(entry: tuple) -> tuple:
    """Total order of captures: URL key, time, page (null last), place in the archives."""
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[3]


def typed(captures: DataFrame, least: int) -> DataFrame:
    """Captures with first_id and first_row of the response they revisit, both null for a response.

    Payloads are grouped by digest with partial sums, and only groups of two and more are joined back: broadcast if they
    are counted to be few, else by a shuffle whose skewed partitions adaptive execution splits.
    """
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    groups = captures.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    groups, _ = materialize(groups.where("n > 1").select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")), "equal")
    joined = captures.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups.hint("merge"), "payload_digest", "left")
    again = F.col("first_row") != F.col("row")
    return joined.withColumns({"first_id": F.when(again, F.col("first_id")), "first_row": F.when(again, F.col("first_row"))})


def record(page_id, row, url, captured, payload, digest, size, first_id, first_row) -> bytes:
    """One WARC record without the blank lines that end it."""
    again = first_row is not None
    name = lambda i, r: f"<urn:x-capture:{'null' if i is None else i}:{r}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}".encode()
    block = http if again else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {name(page_id, row)}", f"WARC-Date: {captured}"]
    lines += [f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []
    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first_id, first_row)}"] if again else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block


def write(df: DataFrame, out: str, captured: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write one WARC record per row to gzipped files under `out`, of at most `file_bytes` each unless one record is longer.

    Of payloads of `least` bytes and more that are equal, the one with the smallest id (a null id comes last; of
    repeated rows any one) is a response, and the others are revisits of it.
    """
    spark = prepare(df.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), captured.alias("captured"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "row": F.monotonically_increasing_id()})
    rows, scratch = materialize(rows, "captures")

    def run(batches):
        import pyarrow as pa

        file, size, held = 0, 0, []
        batch = lambda: pa.record_batch([pa.array([x for x, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int32())], names=["value", "file"])
        for b in batches:
            waiting = 0
            for k in range(b.num_rows):
                data = record(*(c[k].as_py() for c in b.columns))
                if size and size + len(data) > file_bytes:
                    file, size = file + 1, 0
                size, waiting = size + len(data), waiting + len(data)
                held.append((data, file))
                if waiting > WRITE_BATCH:
                    yield batch()
                    held, waiting = [], 0
            if held:
                yield batch()
                held = []

    records = typed(rows, least).select("page_id", "row", "url", "captured", "payload", "payload_digest", "payload_bytes", "first_id", "first_row").mapInArrow(trimmed(run), "value binary, file int")
    # a cast from binary keeps the bytes as they are, also where they are no UTF-8
    records.select(F.col("value").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(out)
    discard(spark, scratch)


def records_of(chunks):
    """(headers, block, offset) of every WARC record in a stream of bytes; the blank lines after each are checked."""
    held, at = bytearray(), 0

    def until(test):
        while (found := test()) is None:
            more = next(chunks, None)
            if more is None:
                return None
            held.extend(more)
        return found

    while True:
        searched = 0

        def head():
            nonlocal searched
            k = held.find(b"\r\n\r\n", searched)
            searched = max(0, len(held) - 3)
            return None if k < 0 else k

        end = until(head)
        if end is None:
            if held:
                raise ValueError("an archive ends inside of a record")
            return
        version, *lines = held[:end].decode().split("\r\n")
        headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(headers["content-length"])
        whole = end + 4 + size + 4
        if not version.startswith("WARC/") or until(lambda: True if len(held) >= whole else None) is None or held[whole - 4 : whole] != b"\r\n\r\n":  # noqa: B023
            raise ValueError("an archive ends inside of a record")
        yield headers, bytes(held[end + 4 : end + 4 + size]), at
        at += whole
        del held[:whole]


def unpacked(data: bytes, size: int = 1 << 20):
    """The contents of a gzip file piece by piece."""
    while data:
        stream = zlib.decompressobj(31)
        rest = data
        while rest and not stream.eof:
            yield stream.decompress(rest, size)
            rest = stream.unconsumed_tail
        if tail := stream.flush():
            yield tail
        data = stream.unused_data


def entry_of(headers: dict, block: bytes, place: str) -> tuple:
    """An index entry; a response's payload must have the digest its header states."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} isn't the one that was written")
    number = lambda k: (lambda x: None if x == "null" else int(x))(headers[k].split(":")[2]) if k in headers else None
    url = headers.get("warc-target-uri")
    return url_key(url), headers["warc-date"], number("warc-record-id"), place, url, headers["warc-type"], digest, size, number("warc-refers-to")


def arrow_blocks(run: int, group: int, entries: list[tuple], size: int):
    """Blocks of a sorted list of entries as record batches."""
    import pyarrow as pa

    kinds = pa.struct([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ENTRY.split(", ")])
    for k in range(0, len(entries), size):
        some = entries[k : k + size]
        columns = [pa.array(c, kinds[n].type) for n, c in enumerate(zip(*some))]
        values = pa.StructArray.from_arrays(columns, fields=list(kinds))
        found = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), values)
        yield pa.record_batch([pa.array([run]), pa.array([group]), pa.array([sortable(some[0])], pa.binary()), found], names=["run", "grp", "first", "entries"])


def sortable(entry: tuple) -> bytes:
    """Bytes that sort as order_of does: strings end with a zero byte, inside of which zero bytes are escaped."""
    text = lambda x: x.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"
    page = b"\1" + bytes(8) if entry[2] is None else b"\0" + (entry[2] + (1 << 63)).to_bytes(8, "big")
    return text(entry[0]) + text(entry[1]) + page + text(entry[3])


def runs(spark: SparkSession, out: str, run_size: int = RUN, block: int = BLOCK) -> DataFrame:
    """The archives under `out` as sorted runs of at most run_size captures, in blocks (run, grp, first, entries)."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            for k in range(b.num_rows):
                path = "/".join(b.column(0)[k].as_py().split("/")[-2:])
                for headers, block_, at in records_of(iter(unpacked(b.column(1)[k].as_py()))):
                    held.append(entry_of(headers, block_, f"{path}:{at:012d}"))
                    if len(held) == run_size:
                        yield from arrow_blocks(number, 0, sorted(held, key=order_of), block)
                        number, held = number + 1, []
        yield from arrow_blocks(number, 0, sorted(held, key=order_of), block)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(out)
    return files.select("path", "content").mapInArrow(trimmed(run), BLOCK_SCHEMA)


class LoserTree:
    """The smallest head of k streams: every inner node holds the loser of its match, so a step replays one path only."""

    def __init__(self, streams: list):
        self.streams, self.k = streams, len(streams)
        self.heads = [next(s, None) for s in streams]
        self.losers = [-1] * self.k
        for leaf in range(self.k - 1, -1, -1):
            self.replay(leaf, starting=True)

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def replay(self, leaf: int, starting: bool = False) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node:
            rival = self.losers[node]
            if rival == -1 and starting:
                self.losers[node] = winner
                return
            if not self.before(winner, rival):
                self.losers[node], winner = winner, rival
            node //= 2
        self.winner = winner

    def peek(self):
        return self.heads[self.winner] if self.k else None

    def pop(self):
        best = self.heads[self.winner]
        self.heads[self.winner] = next(self.streams[self.winner], None)
        self.replay(self.winner)
        return best


def merged(blocks):
    """Entries in order from (first, entries) blocks that come in the order of their first keys.

    Blocks of one run follow each other, so about one for each run is open at any time, whatever the runs' lengths. A
    block is opened when its first key isn't above the smallest open one; then the tree is built anew.
    """
    keyed = lambda entries: ((sortable(e), e) for e in entries)
    tree = LoserTree([])
    blocks = iter(blocks)
    coming = next(blocks, None)
    while True:
        head = tree.peek()
        if coming is not None and (head is None or coming[0] <= head[0]):
            streams = [iterate(h, s) for h, s in zip(tree.heads, tree.streams) if h is not None]
            while coming is not None and (head is None or coming[0] <= head[0]):
                streams.append(keyed(coming[1]))
                head, coming = head or (coming[0],), next(blocks, None)
            tree = LoserTree(streams)
        elif head is None:
            return
        else:
            yield tree.pop()[1]


def iterate(head, rest):
    yield head
    yield from rest


def blocks_of(batches):
    """(grp, first, entries) of batches of blocks, entries as tuples."""
    for b in batches:
        for k in range(b.num_rows):
            part = b.slice(k, 1)
            entries = part.column("entries").flatten()
            yield part.column("grp")[0].as_py(), part.column("first")[0].as_py(), [*zip(*(entries.field(c).to_pylist() for c in FIELDS))]


def by_group(blocks):
    """(grp, iterator of (first, entries)) of blocks sorted by grp; an iterator must be used up before the next."""
    from itertools import groupby

    for grp, found in groupby(blocks, key=lambda x: x[0]):
        yield grp, ((first, entries) for _, first, entries in found)


def in_groups(blocks: DataFrame) -> DataFrame:
    """Blocks of a group together in a task, in the order of their first keys."""
    return blocks.repartition(partitions(blocks.sparkSession), "grp").sortWithinPartitions("grp", "first").select("grp", "first", "entries")


def fewer_runs(blocks: DataFrame, fan_in: int, block: int) -> DataFrame:
    """One round of merging: each `fan_in` runs become one."""

    def run(batches):
        for grp, found in by_group(blocks_of(batches)):
            held = []
            for entry in merged(found):
                held.append(entry)
                if len(held) == block:
                    yield from arrow_blocks(grp, 0, held, block)
                    held = []
            yield from arrow_blocks(grp, 0, held, block)

    return in_groups(blocks).mapInArrow(trimmed(run), BLOCK_SCHEMA)


def cut(blocks: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Blocks cut at the splitters; grp is the range."""
    from bisect import bisect_right

    def run(batches):
        for _, _, entries in blocks_of(batches):
            held, at = [], None
            for e in entries:
                if (here := bisect_right(splitters, sortable(e))) != at:
                    yield from arrow_blocks(0, at or 0, held, len(held) or 1)
                    held, at = [], here
                held.append(e)
            yield from arrow_blocks(0, at or 0, held, len(held) or 1)

    return blocks.select("grp", "first", "entries").mapInArrow(run, BLOCK_SCHEMA)


def merge_index(blocks: DataFrame, fan_in: int = FAN_IN, block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """All captures of sorted runs: the columns of ENTRY, position (from 0, in the order of the whole index) and
    capture_no (from 1, in the history of its URL key). Written to the shared folder."""
    if fan_in < 2:
        raise ValueError("a merge takes two runs at least")
    spark, old = blocks.sparkSession, []
    blocks, scratch = materialize(blocks, "runs")
    while True:
        old.append(scratch)
        numbers = blocks.select("run").distinct()
        n = numbers.count()
        if n <= fan_in:
            break
        # runs are dealt to groups by hashes; a group of more runs than the fan-in only has some more open blocks
        grouped = blocks.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(-(-n // fan_in))))
        blocks, scratch = materialize(fewer_runs(grouped, fan_in, block), "runs")
    some = blocks.select("first").orderBy(F.xxhash64("first")).limit(SPLITTER_SAMPLE).collect()
    firsts, wanted = sorted(bytes(r["first"]) for r in some), ranges or partitions(spark)
    splitters = sorted({firsts[len(firsts) * k // wanted] for k in range(1, wanted)} if firsts else ())

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in ENTRY.split(", ")]

        def batch(grp, at, held, counts):
            arrays = [pa.array(c, t) for c, t in zip(zip(*held), kinds)]
            return pa.record_batch([*arrays, pa.array([grp] * len(held), pa.int64()), pa.array(range(at, at + len(held)), pa.int64()), pa.array(counts, pa.int64())], names=[*FIELDS, "grp", "position", "capture_no"])

        for grp, found in by_group(blocks_of(batches)):
            at, held, counts, key, seen = 0, [], [], None, 0
            for entry in merged(found):
                key, seen = entry[0], seen + 1 if entry[0] == key else 1
                held.append(entry)
                counts.append(seen)
                if len(held) == block:
                    yield batch(grp, at, held, counts)
                    at, held, counts = at + len(held), [], []
            if held:
                yield batch(grp, at, held, counts)

    index, scratch = materialize(in_groups(cut(blocks, splitters)).mapInArrow(trimmed(run), f"{ENTRY}, grp long, position long, capture_no long"), "ranges")
    old.append(scratch)
    edges = index.groupBy("grp").agg(F.count("*").alias("n"), F.min_by("url_key", "position").alias("first_key"), F.max_by("url_key", "position").alias("last_key"), F.max_by("capture_no", "position").alias("seen"))
    begins, at, last, seen = [], 0, None, 0
    for r in sorted(edges.collect(), key=lambda r: r["grp"]):  # one row for each range
        carried = seen if at and r["first_key"] == last else 0
        begins.append((r["grp"], at, r["first_key"], carried))
        at, last, seen = at + r["n"], r["last_key"], r["seen"] + (carried if r["first_key"] == r["last_key"] else 0)
    begins = spark.createDataFrame(begins, "grp long, _at long, _key string, _carried long")
    carried = F.when(F.col("url_key") == F.col("_key"), F.col("_carried")).otherwise(0)
    placed = index.join(F.broadcast(begins), "grp").select(*FIELDS, (F.col("position") + F.col("_at")).alias("position"), (F.col("capture_no") + carried).alias("capture_no"))
    out, _ = materialize(placed, "index")
    discard(spark, *old)
    return out


def archive_index(df: DataFrame, out: str, captured: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, run_size: int = RUN, block: int = BLOCK, fan_in: int = FAN_IN, ranges: int | None = None) -> DataFrame:
    """Write df's pages as WARC files under `out`, read them back and return the merged index, one row per record.

    Null html: an empty payload. Null URL: no target, an empty key, first in the index. Null id: last among equal URL
    keys and times. Repeated rows: a record each. An empty table: an empty index. Other columns are ignored.
    """
    spark = prepare(df.sparkSession)
    write(df, out, captured, id_col, url_col, html_col, least, file_bytes)
    return merge_index(runs(spark, out, run_size, block), fan_in, block, ranges)


def op13_loser_tree_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC files of all pages in the shared folder and their index. The table has no times: a page's stands in, a
    second for each id from 2020 on."""
    moment = F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    captured = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    found = archive_index(table(spark, sf_dir, "pages"), out, captured)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position", "capture_no")


#: keys, positions and histories hold for absolute URLs without port or user, as the table's are
OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS b, strftime(make_timestamp((1577836800 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured,
    regexp_extract(lower(url), '^[a-z]+://(?:www[0-9]*[.])?([^/?#]*)([^?#]*)[?]?([^#]*)', ['host', 'path', 'query']) AS u
  FROM pages
), d AS (
  SELECT r, page_id, captured, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest, array_to_string(list_reverse(string_split(u.host, '.')), ',') || ')'
    || coalesce(nullif(rtrim(regexp_replace(u.path, '/+', '/', 'g'), '/'), ''), '/') || CASE WHEN u.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(u.query, '&')), '&') END AS url_key
  FROM p
), f AS (SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND r <> first_r THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND r <> first_r THEN first_id END AS refers_to, url_key, captured,
  row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position, row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS capture_no
FROM f
"""
