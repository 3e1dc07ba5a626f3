import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import queries, tokens, warc

DOC = "doc_id long, text string, source string, path string, ids string"


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_pack_round_trip(values, narrow):
    ids = np.array(values, "<u4") >> np.uint32(narrow - 1 if narrow < 32 else 31)
    blocks = tokens.pack(ids)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    assert np.array_equal(tokens.unpack(b"".join(blocks), starts), ids)


def test_outliers_become_exceptions():
    ids = np.full(512, 7, "<u4")
    ids[5] = 50_000
    (block,) = tokens.pack(ids)
    assert len(block) == 9 + 0 + 2 + 4
    assert np.array_equal(tokens.unpack(block, np.array([0])), ids)


LATIN = "".join(map(chr, [*range(256)]))
PLAIN = st.text(alphabet="ab é\n\t.1'sß漢 ", max_size=60)
SIGNS = st.text(alphabet=LATIN + "\u0301\u200d\ufeff\u2019\u01c5Ⅷ٣①\U0001f600漢\u00ad", max_size=60)
SAID = st.lists(st.sampled_from(["don't", "IT'S", "we'll", "'tis", "x'", "'re", "l'été", "3rd", "1,000.5", "(a)", "½", "\xa0", "\n", "\n\n", " ", "  ", "\t", "<|endoftext|>", "Ünï", "e\u0301", "a\xadb", "C++", "'"]), max_size=12)


@given(st.lists(st.one_of(PLAIN, SIGNS, SAID.map(" ".join), SAID.map("".join)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_encoder_equals_library(texts):
    path = public_tokenizers.path(tokens.VOCABULARY)
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(path).encode(texts)] == want


def test_encoder_asks_for_each_part_once():
    enc = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    asked, model = [], enc.model
    enc.model = lambda part: asked.append(part) or model(part)
    words = [f"{a}{b}ér" for a in ("thon", "blea", "Oer") for b in ("nd", "tion", "sh", "ly")]
    forms = [f"x {w} {w}, {w}.%%% {w}-{w}; {w}" for w in words]
    first = enc.encode(forms)
    assert enc.encode(forms) == first
    assert len(asked) == len(set(asked))


@given(st.lists(st.one_of(PLAIN, SIGNS, SAID.map(" ".join)), max_size=30))
@settings(max_examples=50, deadline=None)
def test_generations_of_kept_words(texts):
    path = public_tokenizers.path(tokens.VOCABULARY)
    small = tokens.Encoder(path, memo=6)
    want = tokens.encoder(path).encode(texts)
    assert [small.encode([t])[0] for t in texts] == want
    assert all(not getattr(kept.older, "older", None) for kept in (small.memo, small.inner))


def test_kept_words_stay_within_the_limit():
    enc = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), memo=40)
    common = "the water of that river"
    # All in one call, as a batch of long texts is.
    enc.encode([f"{common} {' '.join(f'{a}{b}{n}' for b in 'klmnopqr')}" for n in ("ard", "esh", "olt", "ump") for a in "bcdfg"])
    assert len(enc.memo) + len(enc.memo.older) <= 40 + 12
    assert enc.memo.older and not set(enc.memo) & set(enc.memo.older)


def test_workers_free_other_operators_tables_first(monkeypatch):
    from tessera.llm import common

    freed = []
    monkeypatch.setattr(common, "HELD", {"lm": {}, "tokens": {}})
    monkeypatch.setattr(common, "_release", lambda: freed.append(set(common.HELD)))
    common._keep_only("tokens")
    common._keep_only("tokens")
    assert freed == [{"tokens"}]


def brute_tokens(rows):
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_ids", [1 << 20, 50])
def test_token_files_edge_cases(spark, shard_ids):
    rows = [(3, "a b", "s", "p", "i"), (1, None, None, None, None), (None, "null id", "s", "p", "i"), (2, "", "s", "p", "i"), (2, "x" * 30_000 + " <|endoftext|> y", "s", "p", "i"), (3, "a b", "s", "p", "i"), (9, "word " * 20_000, "s", "p", "i")]
    read = tokens.read_tokens(tokens.write_tokens(spark.createDataFrame(rows, DOC), shard_ids=shard_ids))
    got = read.collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == brute_tokens([r[:2] for r in rows])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_token_files_empty_table(spark):
    assert tokens.read_tokens(tokens.write_tokens(spark.createDataFrame([], DOC))).count() == 0


def test_token_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op6_token_files(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == brute_tokens([tuple(r) for r in docs])


def brute_warc(rows):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        low = first.get(html or "")
        refers = low if low is not None and low != page else None
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers, True))
    return sorted(out, key=str)


PAGE = "page_id long, url string, html string, payload string, digest string"


@pytest.mark.parametrize(("segment_bytes", "archive_bytes"), [(16384, 64 << 20), (64, 500)])
def test_warc_edge_cases(spark, segment_bytes, archive_bytes):
    rows = [(5, "http://a/", "same"), (2, None, "same"), (2, "x\r\ny: z", "same"), (7, "u", None), (8, "u", ""), (None, "u", "same"), (9, "ü", "é漢\r\n0\r\n\r\n" * 700), (4, "u", "é漢\r\n0\r\n\r\n" * 700), (11, "u", "WARC/1.1\r\n" * 50), (12, "u", "long" * 5000), (12, "u", "long" * 5000)]
    frame = spark.createDataFrame([(*r, "p", "d") for r in rows], PAGE)
    got = warc.round_trip(frame, segment_bytes=segment_bytes, archive_bytes=archive_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in got), key=str) == brute_warc([(r[0], r[2]) for r in rows])


def test_warc_empty_and_small_payloads(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0
    frame = spark.createDataFrame([(1, "u", "ab", "p", "d"), (2, "u", "ab", "p", "d")], PAGE)
    assert {r.record_type for r in warc.round_trip(frame, min_bytes=3).collect()} == {"response"}


def test_incomplete_segments_are_told(spark):
    frame = spark.createDataFrame([(1, "u", "x" * 1000, "p", "d")], PAGE)
    records = warc.read_records(warc.write_archives(frame, segment_bytes=100))
    (row,) = warc.reassemble(records.where("segment != 3")).collect()
    assert not row.complete and row.payload is None
    (row,) = warc.reassemble(records).collect()
    assert row.complete and bytes(row.payload) == b"x" * 1000


def test_warc_query_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    got = queries.op9_warc(spark, sf_dir).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in got), key=str) == brute_warc([tuple(r) for r in pages])


def test_shared_folder_can_be_cleared(spark):
    from tessera.llm.common import clear_shared, materialise

    kept = materialise(spark.range(3).toDF("id"), "clear")
    path = kept.inputFiles()[0]
    clear_shared(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
