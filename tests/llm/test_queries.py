"""The registered queries of the operators on whole tables, held against what they must return: null and empty texts,
copies, planted passages, values and vectors among the rows."""

import zlib
from array import array
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from stylometra.llm.encoding import vocabulary
from stylometra.llm.queries import ORACLE_SQL, QUERIES
from stylometra.llm.tokencounts import Trie, pieces, pretokens

CARD = "4111 1111 1111 1111"
NEW = 900_000


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The given tables, with odd documents behind the others."""
    out = tmp_path_factory.mktemp("tables")
    for p in Path(sf).glob("*.parquet"):
        if p.stem != "documents":
            (out / p.name).symlink_to(p)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()
    texts = [None, "", "12345 !!! ??", first["text"], f"Words of our own before it. {item['text']} And words after it.", f"Paid by {CARD}, and {CARD} again.", "Straße ÉTÉ naïve œuvre"]
    odd = [(NEW + k, t, "en" if k % 2 else None, "odd", len(t or "")) for k, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def encoded(name, texts, end):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    order = sorted(texts)
    return {i: x.ids + [end] for i, x in zip(order, t.encode_batch([texts[i] for i in order], add_special_tokens=False))}


def crc(ids):
    packed = array("I", ids)
    assert packed.itemsize == 4
    return zlib.crc32(packed.tobytes())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)] and {*ORACLE_SQL} <= {*QUERIES}
    assert {*QUERIES, "pipeline"} <= {*__spark_entry__.queries()} and {*ORACLE_SQL} <= {*__spark_entry__.oracle_sql()}


def test_packed_pieces(spark, folder, texts):
    rows = QUERIES["op2_vector_packing"](spark, folder).collect()
    ids = encoded("byte_bpe_50k.json", texts, 0)
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        of_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {*of_doc} == {*texts}
    for i, found in of_doc.items():
        at = 0
        for start, n, c, total in sorted(found):
            assert (start, total, c) == (at, len(ids[i]), crc(ids[i][at : at + n])) and n > 0
            at += n
        assert at == len(ids[i])
    used = padded = 0
    for found in of_sequence.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 1024
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 1024)
    assert padded <= 1.02 * used


def test_token_file_rows(spark, folder, texts):
    rows = sorted(map(tuple, QUERIES["op3_rans_token_file"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    ids, want, at = encoded("word_bpe_49k.json", texts, 2), [], 0
    for i in sorted(ids):
        want.append((i, at, len(ids[i]), crc(ids[i])))
        at += len(ids[i])
    assert rows == want


def test_languages_of_held_out_documents(spark, folder, texts):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op5_crf_language"](spark, folder).collect()}
    assert {*got} == {*texts}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in got.items() if r["held_out"]) == sorted(held)
    known = [i for i in held if i < NEW and langs[i]]
    assert sum(got[i]["lang_pred"] == langs[i] for i in known) >= 0.95 * len(known) > 20
    assert [got[NEW + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[NEW + 6]["lang_pred"] != "und"
    assert all(r["lang_pred"] in {*langs.values(), "und"} and 0 <= r["score"] <= 1 for r in got.values())


def test_planted_item_is_found(spark, folder):
    rows = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op6_cgk_decontamination"](spark, folder).collect()}
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first()["item_id"]
    assert rows[(NEW + 4, item)]["distance"] == 0 and rows[(NEW + 4, item)]["start_word"] == 6
    assert not any(i in range(NEW, NEW + 3) or i in (NEW + 5, NEW + 6) for i, _ in rows)


def test_values_keep_their_form_and_stay_linked(spark, folder, texts):
    got = {r["doc_id"]: r for r in QUERIES["op7_feistel_pseudonyms"](spark, folder).collect()}
    assert {*got} == {*texts} and got[NEW]["text"] is None and got[NEW + 3]["text"] == got[min(got)]["text"]
    assert all((r["text"] or "") == texts[i] for i, r in got.items() if r["n_replaced"] == 0)
    new = got[NEW + 5]["text"]
    first, second = new[8:27], new[33:52]
    assert got[NEW + 5]["n_replaced"] == 2 and first == second != CARD and [k for k, x in enumerate(first) if x == " "] == [4, 9, 14]
    assert len(new) == len(texts[NEW + 5])


def test_counts_of_tokens(spark, folder, texts):
    trie, known = Trie(pieces(vocabulary("piece_bpe_32k.model"))), {}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_trie_token_counts"](spark, folder).collect()}
    assert {*got} == {*texts}
    for i, text in texts.items():
        assert got[i] == sum(known.setdefault(w, trie.insert(w)[0]) for w in pretokens(text)) if text else got[i] == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, folder, name):
    """op9 may miss links (its recall is measured); here it misses none."""
    df = QUERIES[name](spark, folder)
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark conversations".split():
        source = f"{folder}/{t}.parquet" + ("/*.parquet" if t == "documents" else "")
        c.execute(f"create view {t} as select * from read_parquet('{source}')")
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want and want
