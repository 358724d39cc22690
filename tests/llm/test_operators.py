"""Every training-data operator against brute force, and on nulls, empty and long texts, ties, copies and clashing names."""

import hashlib
import random
import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stylometra.llm import decontamination, pseudonyms, rans
from stylometra.llm.decontamination import clean, contaminated, matches, prepare_items
from stylometra.llm.encoding import CachedEncoder, vocabulary
from stylometra.llm.jaccard import jaccard_join, meeting_chance, shortest_prefix
from stylometra.llm.language import learn, predict, sample
from stylometra.llm.links import components
from stylometra.llm.packing import Limits, pack
from stylometra.llm.preferences import OP1_SQL, format_preferences, op1_preference_format
from stylometra.llm.quantization import embedding_links
from stylometra.llm.shared import HashedWords, rolling, words
from stylometra.llm import suffixdedup
from stylometra.llm.suffixdedup import repeated_spans
from stylometra.llm.suffixes import sorted_suffixes
from stylometra.llm.tokencounts import Trie, count_tokens, pieces, pretokens
from stylometra.llm.tokenfile import read, write

LONG = "the longest text of them all has words like these and those, again and again. " * 3000
TEXTS = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "a text without a number that nobody may lose"), (5, LONG), (6, "  odd \t\n blanks here  "), (7, "12345 !!! ??"), (8, "Straße ÉTÉ naïve œuvre"), (9, "x" * 5000)]
SCHEMA = "doc_id long, text string, lang string, node long, id long, label string, key string, words string, _found string, n_replaced string, bucket int, i long, t string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, 1, 2, "l", "k", "w", "f", "n", 3, 4, "t") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def ids_of(name, text, end=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def _whole(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    cases = [t for _, t in TEXTS] + ["a  b", " a", "a ", "a\n b", "a \nb", "a\0b c", "Σας ΣΑΣ İx", "it's o'clock 's", "x́ y", "\x1c a\x1d b", "<|endoftext|> z"]
    found = CachedEncoder(vocabulary(name)).many(cases)
    assert [array("I", x).tolist() for x in found] == [ids_of(name, t) for t in cases]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_random_texts(name):
    rng = np.random.default_rng(8)
    cases = ["İ. ' 'c", "ǅ ꟲ 𝔘𝔫 ﷺ", *("".join(rng.choice([*"ab cé's.,1\n İΣ日\u0301 "], 40)) for _ in range(400))]
    encode = CachedEncoder(vocabulary(name), limit=300)
    found = [x for k in range(0, len(cases), 50) for x in encode.many(cases[k : k + 50])]
    assert [array("I", x).tolist() for x in found] == _whole(name, cases)


class Recorder:
    """A tokenizer of the library that notes the strings it is given."""

    def __init__(self, library, given):
        self.library, self.given = library, given

    def encode_batch_fast(self, strings, **options):
        self.given.extend(strings)
        return self.library.encode_batch_fast(strings, **options)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_words_of_letters_skip_the_search_for_words():
    text, given = "straße und häuser, kein wort fehlt. Ένα слово\nUND häuser!", []
    encode = CachedEncoder(vocabulary("word_bpe_49k.json"))
    encode.tokenizer = Recorder(encode.tokenizer, given)
    assert [array("I", x).tolist() for x in encode.many([text, "und 12 häuser"])] == [ids_of("word_bpe_49k.json", t) for t in (text, "und 12 häuser")]
    assert not re.search(r"[^\W\d]", "".join(given))


def test_words_are_encoded_once_with_any_signs_and_at_ends_of_lines():
    words = [f"wort{x}{y}é" for x in "abcdefgh" for y in "ijklmnop"]
    texts = ["los " + " ".join(w + s for w in words) + " ende" for s in ("", ",", ".", "?!", ".\nUnd")]
    encode, given = CachedEncoder(vocabulary("byte_bpe_50k.json")), []
    encode.tokenizer = Recorder(encode.tokenizer, given)
    if hasattr(encode, "words"):
        encode.words = Recorder(encode.words, given)
    assert [array("I", x).tolist() for x in encode.many(texts)] == [ids_of("byte_bpe_50k.json", t) for t in texts]
    assert sum(x.count("wort") for x in given) == len(words)


# 1
def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, differ string, n long")


def test_preferences(spark):
    common = [("system", "s"), ("user", "hi")]
    # the rejected side's turns are numbered from 5: places count
    rows = [(1, side, k + first, r, t, "x", 0) for side, first, tail in (("chosen", 0, [("assistant", "yes"), ("user", "more")]), ("rejected", 5, [("assistant", "no")])) for k, (r, t) in enumerate(common + tail)]
    rows += [(2, side, 0, "user", "same", "x", 0) for side in ("chosen", "rejected")] + [(3, "chosen", 0, "assistant", None, "x", 0), (None, "chosen", 0, "user", "?", "x", 0), (4, "other", 0, "user", "?", "x", 0), (5, "rejected", None, None, "r", "x", 0)]
    got = {r["pair_id"]: r for r in format_preferences(turns(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    one = got[1]
    assert one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n"
    assert [one["chosen"][s["start"] : s["start"] + s["length"]] for s in one["chosen_loss"]] == ["yes<|end|>\n"]
    assert [one["rejected"][s["start"] : s["start"] + s["length"]] for s in one["rejected_loss"]] == ["no<|end|>\n"]
    assert got[2]["prompt"] and not got[2]["chosen"] and not got[2]["rejected"]
    assert got[3]["prompt"] == "" and got[5]["rejected"] == "<||>\nr<|end|>\n"
    assert format_preferences(turns(spark, [])).count() == 0


def test_long_preferences_go_on_in_further_rows(spark):
    """A pair beyond the limit gives the same strings and spans, in parts."""
    rng = np.random.default_rng(3)
    rows = [(p, side, k, ["user", "assistant"][k % 2], f"t{k}" if k < 13 * p or side == "chosen" else f"u{k}", "x", 0) for p in (1, 2, 3) for side, n in (("chosen", 40), ("rejected", 33)) for k in rng.permutation(n).tolist()]
    whole = {r["pair_id"]: r for r in format_preferences(turns(spark, rows)).collect()}
    parts = defaultdict(list)
    for r in format_preferences(turns(spark, rows), most=10).collect():
        parts[r["pair_id"]].append(r)
    for p, some in parts.items():
        some.sort(key=lambda r: r["part_no"])
        assert [r["part_no"] for r in some] == list(range(8))
        for name in ("prompt", "chosen", "rejected"):
            assert "".join(r[name] for r in some) == whole[p][name]
        for name in ("chosen", "rejected"):
            cut = lambda r: [r[name][s["start"] : s["start"] + s["length"]] for s in r[f"{name}_loss"]]  # noqa: B023, E731
            assert [x for r in some for x in cut(r)] == cut(whole[p])


def test_a_pair_of_many_turns_is_one_row(spark):
    rows = [(p, side, k, "assistant", f"t{k}" if k < 6000 * p or side == "chosen" else "u", "x", 0) for p in (1, 2) for side in ("chosen", "rejected") for k in range(10_000)]
    got = {r["pair_id"]: r for r in format_preferences(turns(spark, rows)).collect()}
    assert {p: (r["part_no"], r["prompt"].count("<|end|>"), len(r["chosen_loss"])) for p, r in got.items()} == {1: (0, 6000, 4000), 2: (0, 10_000, 0)}


def test_preferences_sql(spark, sf):
    got = op1_preference_format(spark, sf).toPandas()
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = c.execute(OP1_SQL).fetchdf()[list(got.columns)]
    assert len(got) and sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
    assert got["prompt"].str.len().min() > 0 and got["chosen_loss"].str.len().max() > 0


# 2
def check_packing(rows, want, limits):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    seen = Counter()
    for s in by.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at
            at += r["length"]
            seen[(r["doc_id"], r["doc_tokens"])] += r["length"]
        assert at <= limits.tokens and len(s) <= limits.segments and sum(r["loss_tokens"] for r in s) <= limits.loss_tokens
    pool = Counter()
    for i, ids in want:
        pool[(i, len(ids))] += len(ids)
    assert seen == pool
    for r in rows:
        assert any(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes() == r["ids"] for i, ids in want if i == r["doc_id"])


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 40)])
def test_packing(edge, docs, texts, limits):
    path = vocabulary("byte_bpe_50k.json")
    rows = pack(edge.withColumn("skip", F.lit(5)), limits, path, loss_from=F.col("skip")).collect()
    check_packing(rows, [(i, ids_of("byte_bpe_50k.json", t, 0)) for i, t in TEXTS], limits)
    if limits.tokens == 1024:
        rows = pack(docs, limits, path).collect()
        check_packing(rows, [(i, ids_of("byte_bpe_50k.json", t, 0)) for i, t in texts.items()], limits)
        total = Counter()
        for r in rows:
            total[r["sequence_id"]] += r["length"]
        assert all(n & (n - 1) == 0 for n in total.values())


def test_packing_short_texts_need_no_padding(spark):
    """Sequences that the limit on segments closes are split at powers of two in every pool."""
    df = spark.createDataFrame([(k, "a b") for k in range(4000)], "doc_id long, text string").coalesce(1)
    rows = pack(df, Limits(), vocabulary("byte_bpe_50k.json"), pool_tokens=3000).collect()
    total, seen = Counter(), Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
        seen[r["doc_id"]] += r["length"]
    assert all(n & (n - 1) == 0 for n in total.values()) and len(seen) == 4000 and len(set(seen.values())) == 1


def test_packing_empty(empty):
    assert pack(empty, Limits(), vocabulary("byte_bpe_50k.json")).count() == 0


# 3
@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000, 70_000, 300_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 49_000).astype(np.uint32)
    table = rans.Table(np.bincount(ids, minlength=1))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    if n:
        assert (np.concatenate([rans.decode_part(block, table, t) for t in reversed(rans.parts(block, table))][::-1]) == ids).all()
        with pytest.raises(ValueError):
            rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_token_file(spark, edge, empty, tmp_path):
    write(edge, f"file://{tmp_path}/a", vocabulary("word_bpe_49k.json"), 2, block=64)
    got = sorted(read(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in TEXTS], key=lambda i: (i is not None, i))
    want = [(i, array("I", ids_of("word_bpe_49k.json", t, 2)).tobytes()) for i, t in TEXTS]
    assert sorted([(r["doc_id"] or 0, bytes(r["ids"])) for r in got]) == sorted((i or 0, x) for i, x in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    write(empty, f"file://{tmp_path}/b", vocabulary("word_bpe_49k.json"), 2)
    assert read(spark, f"file://{tmp_path}/b").count() == 0


# 4
def without_repeats(rows, n):
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - n + 1 if i is not None else 0):
            first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1 if i is not None else 0):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i or -1, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def spans_digest(df):
    return sorted((r["doc_id"] or -1, r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in df.collect())


def test_repeated_spans(spark, edge, empty):
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice([*"abc d"], 300))
    more = [(20 + k, "".join(rng.choice([*"abc d"], 80)) + passage[a:z] + "".join(rng.choice([*"xyzé"], 40))) for k, (a, z) in enumerate([(0, 300), (100, 200), (50, 99), (0, 60), (240, 300), (100, 149)])]
    more += [(40, "ab" * 200), (41, "c" + "ab" * 60), (42, passage), (42, passage), (43, passage)]
    rows = [(i, t) for i, t in TEXTS if t != LONG] + more
    got = spans_digest(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(5)))
    assert got == without_repeats(rows, 50)
    assert repeated_spans(empty).count() == 0 and repeated_spans(edge).count() == len(TEXTS)


def test_repeated_spans_documents(docs, texts):
    some = {i: t for i, t in texts.items() if len(t) < 6000}
    assert spans_digest(repeated_spans(docs.where(F.length("text") < 6000))) == without_repeats(list(some.items()), 50)


def test_repeated_spans_many_buckets(spark, docs, monkeypatch):
    """More buckets than two bytes count and than tasks, and a table whose size Spark doesn't know: the same result."""
    rows = docs.where(F.length("text") < 3000).select("doc_id", "text")
    plain = spans_digest(repeated_spans(rows))
    monkeypatch.setattr(suffixdedup, "BUCKET", 1)
    monkeypatch.setattr(suffixdedup, "TASKS", 3)
    unknown = spark.createDataFrame(rows.rdd, rows.schema)
    assert suffixdedup.bucket_count(unknown) == rows.agg(F.sum(F.octet_length("text"))).first()[0] > 1 << 16
    assert spans_digest(repeated_spans(unknown)) == plain


def test_equal_windows_sorts_shared_ones_only(monkeypatch):
    """Windows that no other is equal to aren't sorted, and colliding hashes change nothing."""
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(0, 256, 200, np.uint8))
    strings = [bytes(rng.integers(0, 256, 900, np.uint8)) + passage[k : k + 80] + bytes(rng.integers(0, 256, 900, np.uint8)) for k in range(0, 120, 5)]
    strings += [b"a" * 120, b"a" * 50, b"b" + b"a" * 70, bytes(255 for _ in range(60))]
    lowest = np.arange(len(strings))[::-1] * 3
    first: dict[bytes, int] = {}
    windows = [(s[i : i + 50], n) for s, n in zip(strings, lowest.tolist()) for i in range(len(s) - 49)]
    for w, n in windows:
        first[w] = min(first.get(w, n), n)
    want, sizes, plain = [first[w] for w, _ in windows], [], suffixdedup.sorted_suffixes
    monkeypatch.setattr(suffixdedup, "sorted_suffixes", lambda text, cap: sizes.append(len(text)) or plain(text, cap))
    assert suffixdedup.equal_windows(strings, lowest, 50)[0].tolist() == want
    assert sum(sizes) < sum(map(len, strings)) / 5
    monkeypatch.setattr(suffixdedup, "window_hashes", lambda text, n: np.zeros(max(len(text) - n + 1, 0), np.uint64))
    assert suffixdedup.equal_windows(strings, lowest, 50)[0].tolist() == want


def test_sorted_suffixes_on_disk(monkeypatch):
    """With room for a few bytes only, every queue is a mapped file; the order is the same."""
    from stylometra.llm import suffixes

    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, 3000), 0) for _ in range(20)])
    rows, common = sorted_suffixes(text, 50)
    monkeypatch.setattr(suffixes, "MEMORY", 1000)
    mapped, shared = sorted_suffixes(text, 50)
    assert isinstance(mapped.base, np.memmap) or isinstance(mapped, np.memmap)
    assert (mapped == rows).all() and (shared == common).all()


def test_sorted_suffixes():
    rng = np.random.default_rng(1)
    for k in range(400):
        long = 200 if k % 20 == 0 else 15
        parts = [np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, long)), 0) for _ in range(rng.integers(1, 6))]
        text, cap = np.concatenate(parts), int(rng.integers(2, 12))
        t = text.tolist()
        order = sorted(range(len(t)), key=lambda i: t[i:] + [-1], reverse=True)
        common = [0]
        for i, j in zip(order, order[1:]):
            k = 0
            while k < cap and max(i, j) + k < len(t) and t[i + k] == t[j + k] != 0:
                k += 1
            common.append(k)
        rows, got = sorted_suffixes(text, cap)
        assert rows.tolist() == order and got.tolist() == common


# 5
def test_every_language_is_learned(spark):
    """120 languages, the rarest with a single text; more text than its share doesn't leave Spark."""
    word = lambda k, n: "".join(chr(0x430 + (k * 7 + n * (j + 1) + j * j) % 32) for j in range(3 + n % 4))
    rows = [(1000 * k + i, " ".join(word(k, n) for n in range(40)), f"l{k:03d}", "s") for k in range(120) for i in range(1 + (k % 3) * 2) if zlib.crc32(str(1000 * k + i).encode()) % 5]
    rows += [(10**6 + i, "длинный текст " * 4000, "long", "s") for i in range(200)]
    some = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {lang for _, lang in some} == {r[2] for r in rows} and len(learn(some[:40]).labels) == len({lang for _, lang in some[:40]})
    assert sum(len(t.split()) for t, lang in some if lang == "long") < 24_000 + 8000
    with pytest.raises(ValueError, match="values"):
        sample(spark.createDataFrame([(k, "a text", f"x{k}", "s") for k in range(3000)], "doc_id long, text string, lang string, source string"))


def test_language(spark, docs, edge, empty):
    model = learn(sample(docs))
    got = predict(docs, model).withColumn("held", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).where("held").toPandas()
    assert len(got) > 20 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    found = predict(edge, model).collect()
    assert len(found) == len(TEXTS) and set(edge.columns) <= set(found[0].asDict())
    assert {r["lang_pred"] for r in found if r["text"] in (None, "", "12345 !!! ??")} == {"und"}
    assert predict(empty, model).count() == 0
    nothing = learn(sample(empty))
    assert {r["lang_pred"] for r in predict(edge, nothing).collect()} == {"und"}


def test_code_switching(spark, docs):
    by = defaultdict(list)
    for r in docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0").collect():
        by[r["lang"]].append(r["text"])
    a, b = sorted(by)[:2]
    mixed = " ".join(by[a][0].split()[:60] + by[b][0].split()[:20])
    counts = predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), learn(sample(docs))).first()
    assert counts["lang_pred"] == a and counts["words"][b] > 12


def test_forward_backward():
    from itertools import product

    from stylometra.llm.language import Model

    rng = np.random.default_rng(2)
    m = Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=3), rng.normal(size=(3, 3)))
    e = rng.normal(size=(1, 5, 3))
    weight = {y: np.exp(m.begin[y[0]] + sum(e[0, t, y[t]] for t in range(5)) + sum(m.move[y[t], y[t + 1]] for t in range(4))) for y in product(range(3), repeat=5)}
    total = sum(weight.values())
    want = [[sum(w for y, w in weight.items() if y[t] == k) / total for k in range(3)] for t in range(5)]
    got, logs, *_ = m.marginals(e, np.ones((1, 5), bool))
    assert np.allclose(got[:, 0], want) and np.isclose(logs[0], np.log(total))
    # a chain cut into blocks of two words, beside another chain: the same marginals
    blocks = np.zeros((4, 2, 3))
    blocks[0], blocks[1], blocks[2, 0], blocks[3] = e[0, :2], e[0, 2:4], e[0, 4], e[0, :2]
    there = np.array([[True, True], [True, True], [True, False], [True, True]])
    cut = m.marginals(blocks, there, np.array([True, False, False, True]))[0]
    alone = m.marginals(e[:, :2], np.ones((1, 2), bool))[0]
    assert np.allclose([cut[0, 0], cut[1, 0], cut[0, 1], cut[1, 1], cut[0, 2]], want) and np.allclose(cut[:, 3], alone[:, 0])


# 6
def edit_match(item, text):
    last = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


def test_contaminated(spark, sf, docs, texts, edge, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    rng = np.random.default_rng(8)
    planted = {}
    for k, (i, w) in enumerate(sorted(items.items())):
        if len(w) >= 10:
            w = list(w)
            for _ in range(k % 5):
                p = int(rng.integers(0, len(w)))
                w[p : p + 1] = [["zzz"], [], ["yyy", w[p]]][int(rng.integers(0, 3))]
            planted[10_000 + k] = "Before it, some words. " + " ".join(w).upper() + "; and some words after it."
    rows = [(i, t) for i, t in texts.items() if len(t) < 2500][:60] + list(planted.items())
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {}
    for i, t in rows:
        w = words(t)
        for k, item in items.items():
            d = edit_match(item, w)
            if d <= int((1 - 0.8) * len(item) + 1e-9):
                want[(i, k)] = d
    assert {k: r["distance"] for k, r in got.items()} == want and len(want) >= len(planted)
    for (i, k), r in got.items():
        part = words(dict(rows)[i])[r["start_word"] : r["start_word"] + r["n_words"]]
        assert edit_match(items[k], part) == r["distance"]
    assert contaminated(empty, bench).count() == 0 and contaminated(edge, empty.withColumn("item_id", F.lit(1))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, TEXTS[0][1]), (3, TEXTS[0][1])], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(edge, odd).collect()) == sorted([(1, 3), (4, 3), (4, 3)] * 2)
    left = clean(edge, odd)
    assert left.columns == edge.columns and left.count() == len(TEXTS) - 3


def test_contaminated_long_items(spark):
    """Items of very different lengths, one of 1500 words, edited up to what is allowed."""
    rng = np.random.default_rng(18)
    items = {1: [f"a{k}" for k in range(1500)], 2: [f"b{k}" for k in range(12)], 3: ["c"], 4: [f"d{k % 7}" for k in range(210)]}
    rows = []
    for k, w in items.items():
        for n in (0, int(0.2 * len(w)) if k != 4 else 20):
            edited = list(w)
            for p in rng.permutation(len(w))[:n].tolist():
                edited[p] = "zz"
            rows.append((len(rows), "before it " + " ".join(edited) + " after it", k, n))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string, k int, n int"), bench).collect()}
    want = {(i, k): edit_match(w, words(t)) for i, t, _, _ in rows for k, w in items.items() if k != 1 or t.startswith("before it a0") or len(t) > 8000}
    assert got == {x: d for x, d in want.items() if d <= int(0.2 * len(items[x[1]]) + 1e-9)} and {(r[0], r[2]) for r in rows} <= set(got)


def test_words_are_hashed_by_array_operations(monkeypatch):
    """Equal to the library's hashes of the words, for every code point and length; only long words are handed to it."""
    import xxhash

    rng, library, calls = random.Random(6), xxhash.xxh64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: calls.append(x) or library(x))
    signs = "aZ_9é ßÉİΣς.\n\tñ漢😀𝔸٣½Ⅳ\u0301\u00a0\u2003\x00\ud800-'"
    some = ["".join(rng.choices(signs, k=rng.choice([1, 5, 40, 400]))) for _ in range(500)] + ["b" * n + " é" + "c" * n for n in range(70)]
    some += [None, "", "x" * 5000, "".join(map(chr, range(sys.maxunicode + 1))), "ΑΣ ΑΣ. ΑΣΑ", "the end"]
    got = [h.tolist() for h in HashedWords().many(some)]
    assert min(map(len, calls)) == 32 and len(calls) < len(some)
    assert got == [[library(w.encode("utf-8", "surrogatepass")) for w in words(t)] for t in some]
    assert HashedWords().many([]) == []


def test_seeds_are_sought_in_all_documents_at_once(monkeypatch):
    """As many passes for 300 documents as for one; no match runs from one document into the next, and none is lost at an end."""
    names = [f"w{k}" for k in range(24)]
    items = prepare_items([(1, " ".join(names)), (2, " ".join(names[4:16])), (3, "w3 w9"), (4, "w20")])
    rng = random.Random(16)
    some = ["", " ".join(names[:12]), " ".join(names[12:]), " ".join(names), None, "w3", "w9", "w3 w9", " ".join(names[:20]), "w20"]
    for _ in range(290):
        a, n = rng.randrange(20), rng.randrange(1, 30)
        some.append(" ".join(w if rng.random() < 0.9 else "zz" for w in (names * 2)[a : a + n]))
    hashes = HashedWords().many(some)
    alone = [(d, *m[1:]) for d, h in enumerate(hashes) for m in matches(items, [h])]
    assert sorted(matches(items, hashes)) == sorted(alone)
    found = {(d, i) for d, i, *_ in alone}
    texts = {1: names, 2: names[4:16], 3: ["w3", "w9"], 4: ["w20"]}
    assert found == {(d, i) for d, t in enumerate(some) for i, w in texts.items() if edit_match(w, words(t)) <= int(0.2 * len(w) + 1e-9)}
    calls = []
    monkeypatch.setattr(decontamination, "rolling", lambda h, n: calls.append(n) or rolling(h, n))
    assert matches(items, HashedWords().many(["no word of an item", None, "here"] * 100)) == []
    assert len(calls) == len({q for x in items for q in x.seeds})


# 7
def feistel(symbols, radices, kind, key):
    half = len(symbols) // 2
    a, b, ra, rb = symbols[:half], symbols[half:], radices[:half], radices[half:]
    for i in range(1, pseudonyms.ROUNDS + 1):
        seen = "|".join([key, kind, str(i), ",".join(map(str, a))])
        fresh = [(x + int(hashlib.sha256(f"{seen}|{j}".encode()).hexdigest()[:12], 16)) % r for j, (x, r) in enumerate(zip(b, rb))]
        a, ra, b, rb = fresh, rb, a, ra
    return a + b


def luhn_ok(d):
    return sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark, edge, empty):
    key = "k"
    cases = ["4111111111111111", "4111-1111-1111-1111", "4111111111111112", "+1 (456) 555-2186", "(156) 055-2186", "456-555-2186", "078-05-1120", "666-05-1120", "10.0.0.255", "10.0.0.256", "2024-02-29", "2023-02-29", "29.02.2024", "02/29/2024", "gmeg.95@mail9.example.com", "A@b.co", "plain words 12"]
    rows = [(k, f"See {c}, and {c}! Not x{c}") for k, c in enumerate(cases)]
    got = {r["k"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "k int, text string"), key).collect()}
    new = [re.fullmatch(r"See (.*), and (.*)! Not (.*)", got[k]["text"]).groups() for k in range(len(cases))]
    assert all(a == b for a, b, _ in new)
    out = dict(zip(cases, (a for a, _, _ in new)))
    same = {"4111111111111112", "666-05-1120", "10.0.0.256", "2023-02-29", "plain words 12"}
    assert {c for c in cases if out[c] == c} == same
    digits = lambda s: [int(x) for x in s if x.isdigit()]
    card = feistel(digits("411111111111111"), [10] * 15, "card", key)
    assert digits(out["4111111111111111"])[:15] == card and luhn_ok(digits(out["4111111111111111"]))
    assert digits(out["4111-1111-1111-1111"]) == digits(out["4111111111111111"]) and out["4111-1111-1111-1111"][4] == "-"
    assert digits(out["+1 (456) 555-2186"])[1:] == digits(out["456-555-2186"]) and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out["+1 (456) 555-2186"])
    assert out["10.0.0.255"] == ".".join(map(str, feistel([10, 0, 0, 255], [256] * 4, "ip", key)))
    n = (date(2024, 2, 29) - date(1900, 1, 1)).days
    a, b = feistel([n // 4297, n % 4297], [17, 4297], "date", key)
    day = date(1900, 1, 1) + timedelta(days=a * 4297 + b)
    assert [out["2024-02-29"], out["29.02.2024"], out["02/29/2024"]] == [f"{day:%Y-%m-%d}", f"{day:%d.%m.%Y}", f"{day:%m/%d/%Y}"]
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail9\.example\.com", out["gmeg.95@mail9.example.com"])
    assert got[0]["n_replaced"] == 2 and got[2]["n_replaced"] == 0
    found = pseudonyms.pseudonymize(edge, key)
    assert set(found.columns) == set(edge.columns) and sorted((r["doc_id"] or 0, r["text"] or "", r["_found"]) for r in found.collect()) == sorted((i or 0, t or "", "f") for i, t in TEXTS)
    assert pseudonyms.pseudonymize(empty, key).count() == 0


def test_pseudonyms_inside_of_rejected_strings(spark):
    """Digits beside a value don't hide it: what validation rejects is searched again, with its surroundings."""
    card = "4111 1111 1111 1111"
    cases = [
        (f"{card} 12/27", [card]), (f"{card} 123", [card]), ("7 4111111111111111", ["4111111111111111"]), ("order 2024 456-555-2186", ["456-555-2186"]),
        ("id 2024 078-05-1120", ["078-05-1120"]), ("12345 2024-02-29", ["2024-02-29"]), (f"1234567 {card}", [card]), (f"666-05-{card}", [card]),
        (f"{card} 456-555-2186", [card, "456-555-2186"]), ("12345 67890 abc12@mail.com", ["abc12@mail.com"]), ("12345 67890 123456@mail.com", ["123456@mail.com"]),
        ("1234 5678 9012 3456", []), (f"é 1234 5678 9012 3456, 2023-02-29 and\n{card} 99; {card}", [card, card]), ("1 2 3 4 5 6 7 8 9 1 2 3 4 10.0.0.255", ["10.0.0.255"]),
    ]
    plain = sorted({v for _, values in cases for v in values})
    rows = [(k, t) for k, t in enumerate([*plain, *(t for t, _ in cases)])]
    got = [r for r in sorted(pseudonyms.pseudonymize(spark.createDataFrame(rows, "k int, text string"), "k").collect(), key=lambda r: r["k"])]
    fresh = {v: got[k]["text"] for k, v in enumerate(plain)}
    assert all(v != x for v, x in fresh.items())
    for (text, values), r in zip(cases, got[len(plain) :]):
        at = 0
        for v in values:
            at = text.index(v, at)
            text = text[:at] + fresh[v] + text[at + len(v) :]
            at += len(fresh[v])
        assert (r["text"], r["n_replaced"]) == (text, len(values))


def test_feistel_is_a_permutation(spark):
    rows = spark.range(2000).select(F.array((F.col("id") / 100).cast("long"), F.col("id") % 100).alias("s"))
    out = rows.select(pseudonyms.feistel(F.col("s"), F.array(F.lit(20).cast("long"), F.lit(100).cast("long")), "x", "k").alias("o")).collect()
    assert len({tuple(r["o"]) for r in out}) == 2000 and all(0 <= r["o"][0] < 20 and 0 <= r["o"][1] < 100 for r in out)


# 8
def jaccard_brute(rows, similarity=0.8):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (words(t) for _, t in rows)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i or -1, low.get(root(k), -1), n[k]) for k, (i, _) in enumerate(rows))


def test_jaccard_join(spark, docs, texts, edge, empty):
    digest = lambda df: sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in df.collect())
    assert digest(jaccard_join(docs)) == [(i, max(c, -1) or -1, n) for i, c, n in jaccard_brute(list(texts.items()))] or digest(jaccard_join(docs)) == sorted((i or -1, c or -1, n) for i, c, n in jaccard_brute(list(texts.items())))
    assert digest(jaccard_join(edge)) == jaccard_brute(TEXTS)
    assert jaccard_join(empty).count() == 0


def test_jaccard_large_group(spark):
    """A group of near copies beyond one block: no link is lost, none is counted twice."""
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:60] + [f"x{k}"] + base[60:])) for k in range(1, 700)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_links"] for r in got} == {698} and {r["class_id"] for r in got} == {1}


def join_rows(spark, run):
    """What run returns, and the rows that all joins of its executions made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, rows = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions = store.executionsList(int(before), int(store.executionsCount() - before))
    for e in (executions.apply(k) for k in range(executions.size())):
        metrics, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                    rows += int(metrics.apply(m.accumulatorId()).replace(",", ""))
    return out, rows


def component_edges():
    """Edges (node, first of its bucket) of near copies and of chained buckets, a path of shuffled names, nodes alone."""
    rng = np.random.default_rng(17)
    names = (10_000 + rng.permutation(1000)).tolist()
    found = {*zip(names, names[1:]), *((k, k) for k in range(4000, 4100))}
    for base, places, p in ((0, 16, 0.4), (2000, 2, 0.002)):
        for _ in range(places):
            low = {}
            for node, key in enumerate(rng.geometric(p, 1500)):
                found.add((base + node, low.setdefault(int(key), base + node)))
    return sorted(found)


@pytest.mark.parametrize("few", [4096, 100])
def test_components_join_each_edge_about_once(spark, monkeypatch, few):
    """Rounds work on what is left of the edges: all of them again in each round made 281398 rows on check_h."""
    monkeypatch.setattr("stylometra.llm.links.FEW", few, raising=False)
    edges = component_edges()
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got, rows = join_rows(spark, lambda: components(spark.createDataFrame(edges, "node long, root long")).collect())
    assert {r["node"]: r["root"] for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert rows <= 4 * len(edges) + 3 * len(parent), rows


def test_prefixes_are_shortened_to_the_recall():
    assert shortest_prefix(0.99) > shortest_prefix(0.8) > shortest_prefix(0.5) >= 1
    assert 0.9997 < meeting_chance(shortest_prefix(0.8))(0.8) < 1


# 9
def links_brute(rows, threshold=0.93):
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = Counter(), {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v, l) in enumerate(good):
        for j, w, m in good[:a]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (n[i], root(i)) for i, _, _ in rows}


def test_embedding_links(spark, empty):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        centre = rng.normal(size=64)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in centre + rng.normal(size=64) * 0.26], int(c % 3)) for k in range(8)]
    rows += [(5000, rows[0][1], 0), (5001, rows[0][1], 1), (5002, rows[0][1], None), (5003, None, 0), (5004, [0.0] * 64, 0), (5005, [float("nan")] + [1.0] * 63, 0), (5006, [None] + [1.0] * 63, 0), (5007, [float("inf")] * 64, 0), (5008, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(df).collect()}
    want = links_brute(rows)
    there = sum(n for n, _ in want.values())
    assert there > 100 and all(got[i][0] <= want[i][0] for i in want) and sum(n for n, _ in got.values()) >= 0.97 * there
    assert all(got[i] == (0, i) for i in range(5002, 5009)) and got[5000][0] >= 1
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_links(none).count() == 0


# 10
def unigram(word, vocab, byte):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        ways = [(best[d - 1][0] + n * byte, -(best[d - 1][1] + n))]
        ways += [(best[b][0] + vocab[word[b:d]], -(best[b][1] + 1)) for b in range(max(0, d - 64), d) if word[b:d] in vocab]
        score, count = max(ways)
        best.append((score, -count))
    return best[-1][1], best[-1][0]


def test_token_counts(edge, empty, docs, texts):
    path = vocabulary("piece_bpe_32k.model")
    vocab = pieces(path)
    trie = Trie(vocab, limit=50)
    whole = Trie(vocab)
    some = sorted({w for t in [*texts.values()][:25] for w in pretokens(t)})[:600]
    for w in some:
        want = unigram(w, vocab, whole.byte)
        assert trie.insert(w) == whole.insert(w) and whole.insert(w)[0] == want[0] and abs(whole.insert(w)[1] - want[1]) < 1e-9
    assert len(whole.score) < sum(map(len, some))
    long = "".join(np.random.default_rng(2).choice([*"abcdeé.  ".replace(" ", "")], 9000))
    assert whole.insert(long)[0] == unigram(long, vocab, whole.byte)[0] and len(whole.score) < 9000 + sum(map(len, some))
    got = count_tokens(edge, path).collect()
    assert len(got) == len(TEXTS)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] or -1, r["n_tokens"])), sorted(TEXTS, key=lambda x: (x[0] or -1))):
        if t != LONG:
            assert r["n_tokens"] == sum(unigram(w, vocab, whole.byte)[0] for w in pretokens(t)) if t else r["n_tokens"] == 0
    assert count_tokens(empty, path).count() == 0
    assert pretokens("a  b") == ["▁a", "▁▁b"] or "".join(pretokens("a  b")) == "▁a▁▁b"
