"""Hard negatives, vector codes and web archives against brute force, SQL, and odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stylometra.llm import archives, productcodes
from stylometra.llm.archives import LoserTree, archive_index, merged, order_of, records_of, sortable, unpacked, url_key
from stylometra.llm.negatives import hard_negatives
from stylometra.llm.productcodes import Rounds, distances, product_codes
from stylometra.llm.queries import ORACLE_SQL, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, row long, v string, code string, g int, n int, entries string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", "c", 2, 3, "e") for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("name", ["op11_sorted_hard_negatives", "op12_hamerly_codes", "op13_loser_tree_archive"])
def test_registered_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    c = duckdb.connect()
    for t in ("embeddings", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want


def odd_vectors(n=400, seed=3):
    """Whole small components, so that scores and distances tie often; copies, repeated ids, nulls."""
    rng = random.Random(seed)
    rows = [(k, [rng.randint(-3, 3) / 256 for _ in range(8)], rng.randint(0, 2)) for k in range(n)]
    rows += [(k, rows[7][1], rows[7][2]) for k in range(n, n + 150)]  # many copies of one vector
    rows += [rows[10], rows[10], rows[50], (50, [1.0] * 8, 1)]  # repeated rows, an anchor's id twice with another vector
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [math.nan] + [0.0] * 7, 1), (903, [math.inf] + [0.0] * 7, 1), (None, [0.5] * 8, 1), (904, [0.5] * 8, None), (905, [0.0] * 8, 2), (906, [-0.001] * 8, 0), (950, [0.5] * 5, 1), (951, [0.25] * 5, 0), (952, [], 1)]
    return rows


def usable(rows):
    return [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float)], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_negatives(rows):
    rows = [r for r in usable(rows) if r[0] is not None and r[2] is not None]
    out = []
    for a, (i, x, label) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, other == label) for b, (j, y, other) in enumerate(rows) if b != a and len(x) == len(y))
        for s, j, _ in [r for r in scored if r[2]][:5]:
            fit = [(t, k) for t, k, own in scored if not own and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 512), (37, 3)])
def test_hard_negatives(spark, blocks):
    rows = odd_vectors()
    got = hard_negatives(vectors(spark, rows), F.col("id") % 50 == 0, F.col("label"), rows_a_block=blocks[0], anchors_a_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_one_label_and_of_nothing(spark):
    for rows in ([], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1)]):
        assert hard_negatives(vectors(spark, rows), F.col("id") % 50 == 0, F.col("label")).collect() == []


def brute_codes(rows, parts, entries, rounds):
    rows = [r for r in usable(rows) if len(r[1]) == 8]
    x = np.array([r[1] for r in rows]).reshape(len(rows), parts, -1)
    first = sorted((k for k, r in enumerate(rows) if r[0] is not None), key=lambda k: (rows[k][0], x[k].astype("<i8").tobytes()))[:entries]
    book = x[first].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None].transpose(0, 1, 2, 3)) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    own = x[code[:, p] == e, p]
                    book[p, e] = own.sum(axis=0) // len(own)
    error = d.min(axis=2).sum(axis=1)
    by = {}
    for r, e in zip(rows, error.tolist()):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(r[0], bytes(c.astype(np.uint8)).hex(), e, by[r[2]], digest) for r, c, e in zip(rows, code, error.tolist())]


@pytest.mark.parametrize("entries, rounds", [(16, 2), (5, 6), (256, 1), (1, 2)])
def test_vector_codes(spark, entries, rounds):
    rows = odd_vectors()
    got = product_codes(vectors(spark, rows), parts=4, entries=entries, rounds=rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    whole = [tuple(r) for r in got if r["code"] is not None]
    assert sorted(map(repr, whole)) == sorted(map(repr, brute_codes(rows, 4, entries, rounds)))
    assert sorted(r["vec_id"] for r in got if r["code"] is None) == [950, 951]


def test_vector_codes_of_few_rows(spark, monkeypatch):
    assert product_codes(vectors(spark, [])).collect() == []
    assert product_codes(vectors(spark, [(1, None, 1)])).collect() == []
    one = product_codes(vectors(spark, [(3, [0.5] * 16, None), (3, [0.5] * 16, None)])).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        product_codes(vectors(spark, [(1, [0.5] * 17, 1)]))
    monkeypatch.setattr(productcodes, "FEW_LABELS", 0)
    rows = odd_vectors()
    got = product_codes(vectors(spark, rows), parts=4, entries=5, rounds=1).where("code is not null").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, brute_codes(rows, 4, 5, 1)))


def test_bounds_keep_ties_and_spare_scans():
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (3000, 2, 4)).astype(np.int64)
    book = x[:32].transpose(1, 0, 2).copy()
    code, upper, lower = np.zeros((3000, 2), np.uint8), *np.zeros((2, 3000, 2))
    scans = [Rounds(book, None).assign(x, code, upper, lower).sum()]
    for _ in range(8):
        after = book.copy()
        for p in range(2):
            for e in range(32):
                own = x[code[:, p] == e, p]
                if len(own):
                    after[p, e] = own.sum(axis=0) // len(own)
        scans.append(Rounds(after, book).assign(x, code, upper, lower).sum())
        book = after
        for p in range(2):
            d = distances(x[:, p], book[p])
            assert (code[:, p] == d.argmin(axis=1)).all()
            own = np.sqrt(d.min(axis=1))
            d[np.arange(3000), code[:, p]] = 1 << 60
            assert (upper[:, p] >= own).all() and (lower[:, p] <= np.sqrt(d.min(axis=1))).all()
    assert scans[-1] < scans[0] / 2


PAGES = "page_id long, url string, html string, row long, payload string, captured string, grp int, file int, value string, position int"


def odd_pages():
    same, small = "the same payload, long enough to be revisited " * 4, "short"
    rows = [(k, f"https://WWW.Example.com/a/{k % 7}/?b=2&a=1#x", same if k % 3 == 0 else f"page {k} " * 30) for k in range(200, 0, -1)]
    rows += [(k, "http://hot.example.org/", f"capture {k} " * 20) for k in range(1000, 1300)]  # one URL with very many captures
    rows += [(300, None, small), (301, "not a url\r\nX: y", small), (302, "http://[bad", None), (303, "http://e.org:8080/p//q/", ""), (None, "http://e.org/", same), (None, None, None), (150, "http://e.org/again", same), (150, "http://e.org/again", same)]
    rows += [(400, "http://e.org/w", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 20), (401, "http://e.org/u", "żółć 漢字 \x00 🙂" * 20), (402, "http://e.org/long", "a long page, " * 400_000), (403, "http://e.org/tail", "x" * 200 + "\r\n\r\n")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"file_bytes": 5000, "run_size": 9, "block": 4, "fan_in": 3, "ranges": 5}])
def test_archives(spark, tmp_path, sizes):
    rows = odd_pages()
    df = spark.createDataFrame([(*r, 1, "p", "c", 2, 3, "v", 4) for r in rows], PAGES)
    moment = F.concat(F.lit("2020-01-01T00:00:"), F.lpad(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(60)).cast("string"), 2, "0"), F.lit("Z"))
    out = f"file://{tmp_path}/warc"
    got = archive_index(df.repartition(5), out, moment, **sizes).orderBy("position").collect()
    assert [r["position"] for r in got] == [*range(len(rows))]
    keys = [order_of(tuple(r[c] for c in archives.FIELDS)) for r in got]
    assert keys == sorted(keys) and [sortable(tuple(r[c] for c in archives.FIELDS)) for r in got] == sorted(sortable(tuple(r[c] for c in archives.FIELDS)) for r in got)
    seen = {}
    for r in got:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["capture_no"] == seen[r["url_key"]]
    payload = [(i, (html or "").encode()) for i, _, html in rows]
    want = sorted(repr((i, len(b), hashlib.sha256(b).hexdigest())) for i, b in payload)
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in got) == want
    for digest in {r["payload_digest"] for r in got}:
        group = [r for r in got if r["payload_digest"] == digest]
        ids = sorted((r["page_id"] for r in group), key=lambda i: (i is None, i or 0))
        if len(group) == 1 or group[0]["payload_bytes"] < 100:
            assert all(r["record_type"] == "response" and r["refers_to"] is None for r in group)
        else:
            first = [r for r in group if r["record_type"] == "response"]
            assert [r["page_id"] for r in first] == ids[:1]
            assert all(r["refers_to"] == ids[0] for r in group if r["record_type"] == "revisit")
    assert len({r["url"] for r in got if r["url_key"] == url_key("not a url%0D%0AX: y".replace(" ", "%20"))}) == 1


def test_archive_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    assert archive_index(df, f"file://{tmp_path}/none", F.lit("2020-01-01T00:00:00Z")).collect() == []


def test_shuffled_groups_of_equal_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "FEW_GROUPS", 0)
    df = spark.createDataFrame([(k, "u", "the same payload of more than a hundred bytes " * 3, 1, "p", "c", 2, 3, "v", 4) for k in range(50, 0, -1)], PAGES)
    got = archive_index(df, f"file://{tmp_path}/warc", F.lit("2020-01-01T00:00:00Z")).collect()
    assert {r["refers_to"] for r in got if r["page_id"] != 1} == {1} and sum(r["record_type"] == "response" for r in got) == 1


def test_damaged_archives():
    import gzip

    whole = archives.record(1, 2, "http://e.org/", "2020-01-01T00:00:00Z", b"some payload", hashlib.sha256(b"some payload").hexdigest(), 12, None, None)
    data = whole + b"\r\n\r\n"
    assert [b[-12:] for _, b, _ in records_of(iter(unpacked(gzip.compress(data) + gzip.compress(data), 7)))] == [b"some payload"] * 2
    with pytest.raises(ValueError):
        list(records_of(iter([data[:-6]])))
    [(headers, block, _)] = records_of(iter([data]))
    with pytest.raises(ValueError):
        archives.entry_of(headers, block[:-1] + b"?", "x")


def test_loser_tree_and_streamed_blocks():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 7, 16):
        streams = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        tree, got = LoserTree([iter([(x, x) for x in s]) for s in streams]), []
        while tree.peek() is not None:
            got.append(tree.pop()[0])
        assert got == sorted(x for s in streams for x in s)
    entry = lambda: (rng.choice("abc") * rng.randint(0, 2), str(rng.randint(0, 9)), rng.choice([None, *range(-4, 5)]), str(rng.random()), None, "response", "", 0, None)
    runs = [sorted((entry() for _ in range(rng.randint(1, 60))), key=order_of) for _ in range(20)]
    blocks = sorted(((sortable(r[k]), r[k : k + 7]) for r in runs for k in range(0, len(r), 7)), key=lambda b: b[0])
    assert list(merged(blocks)) == sorted((e for r in runs for e in r), key=order_of)


def test_url_keys():
    assert url_key("https://www.Example.com:443/A//b/?z=1&a=2#top") == "com,example)/a/b?a=2&z=1"
    assert url_key(None) == "" and url_key("http://example.com") == url_key("http://www.example.com/") == "com,example)/"
    assert url_key("http://e.org:8080/") == "org,e:8080)/"
