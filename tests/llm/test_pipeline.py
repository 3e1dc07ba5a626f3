import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def stages(spark, sf_dir, tmp_path):
    """Runs all stages over a frame, each result written and read again."""

    def run(docs):
        out = [docs]
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
            out.append(spark.read.parquet(f"{tmp_path}/{name}"))
        return out

    return run


def test_stages_take_effect(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known, unique, clean, mixed, tokens = stages(docs)[1:]
    assert all(x.columns == docs.columns for x in (known, unique, clean, mixed))
    n = [x.count() for x in (docs, known, unique, clean)]
    assert n[0] >= n[1] > n[2] > n[3] > 0.7 * n[0]
    rows = {r.doc_id: r for r in clean.collect()}
    assert len(rows) == n[3]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in rows.values() for i in items)
    copies = {}
    for r in mixed.collect():
        assert rows[r.doc_id] == r
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    whole, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = sorted(tokens.collect(), key=lambda r: r.start)
    for r, doc_id in zip(got, sorted(k for k, c in copies.items() for _ in range(c)), strict=True):
        ids = [*whole.encode(rows[doc_id].text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_edge_cases(spark, stages):
    base = [(k, f"some english words number w{k} and others w{k * 7} like these w{k * 11} here", "en", f"s{k % 3}", 1) for k in range(30)]
    odd = [(100, None, "en", None, None), (101, "", None, "s0", 0), (102, "123", None, "s0", 0), (3, base[3][1], "en", "s0", 1), (None, "a text without an id in english words", None, None, None), (103, "many words " * 20_000, "en", "s1", 1)]
    out = stages(spark.createDataFrame(base + odd, COLUMNS))
    left = [r.doc_id for r in out[3].collect()]
    assert not {100, 101, 102} & set(left) and left.count(3) == 1 and 103 in left and None in left
    assert out[4].columns == out[0].columns


def test_leaks_go_by_id_and_text(spark, sf_dir):
    item = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    clean = "a text of its own about boats, harbours, ropes and weather on the coast"
    docs = spark.createDataFrame([(None, item, "en", "s", 1), (1, item, "en", "s", 1), (1, clean, "en", "s", 1), (None, clean, "en", "s", 1), (2, None, "en", "s", 1)], COLUMNS)
    left = corpus_pipeline.drop_benchmark_leaks(spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, clean), (None, clean), (2, None)}


def test_pipeline_empty(spark, stages):
    assert [x.count() for x in stages(spark.createDataFrame([], COLUMNS))] == [0] * 6


CLASHES = "row id copy copy_ gone again rows leaked leaked_copy found lang_pred score size source_size target copies key check key_ check_ high low all sum turn often node component token n bits prefix class_id held text_hash"


def test_pipeline_keeps_columns_of_any_name(spark, stages):
    names = CLASHES.split()
    rows = [(k, f"some english words number w{k} and others w{k * 7} like these w{k * 11} here", "en", f"s{k % 3}", 1, *[f"{c}{k}" for c in names]) for k in range(40)] + [(3, "a second text of the third id in english words", "en", "s0", 1, *names)]
    out = stages(spark.createDataFrame(rows * 2, COLUMNS + "".join(f", {c} string" for c in names)))
    assert all(x.columns == out[0].columns for x in out[:5])
    assert out[2].count() == len(rows) and set(map(tuple, out[4].collect())) <= set(rows)


def test_runner_agrees_with_itself(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).exceptAll(corpus_pipeline.run(spark, sf_dir)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
