import hashlib
import re

import duckdb
import pytest

from tessera.llm import common, dedup, queries, sql

DOC = "doc_id long, text string, file string, row string, sha string, digest string, first string, size string, _metadata string"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, digest) of every row, sorted; of rows with one id and text one is kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for whole, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(whole.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def told(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in frame.collect()), key=str)


ROWS = [(7, "a  b\tc"), (3, "a b c"), (5, "a b c "), (4, " a b c"), (None, "a b c"), (1, None), (2, ""), (6, " "), (8, "\n\n"), (9, "A b c"), (9, "A b c"), (9, "a b"), (None, "x"), (None, "x"), (10, "é漢\x00 z"), (11, "é漢\x00\x0bz"), (12, "a\xa0b"), (13, "a b"), (14, "long " * 50_000), (15, "long\r\n" * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", "r", "s", "d", "1", "z", "m") for r in rows], DOC)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_edge_cases(spark, digest_bytes):
    assert told(dedup.deduplicate(frame(spark, ROWS), digest_bytes=digest_bytes)) == brute(ROWS)


def test_empty_table(spark):
    assert dedup.deduplicate(frame(spark, [])).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_beyond_broadcasts(spark, monkeypatch, digest_bytes):
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT", 3)
    rows = ROWS + [(100 + k, f"text {k % 40}") for k in range(400)] + [(1000 + k, "hot  text") for k in range(400)]
    assert told(dedup.deduplicate(frame(spark, rows), digest_bytes=digest_bytes)) == brute(rows)


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    """Later batches find what earlier ones left in the state, and a smaller id takes an entry over."""
    seen, state = str(tmp_path / "seen"), str(tmp_path / "state")
    parts = [[(10, "same text"), (11, "other")], [(5, "same  text"), (20, "third")], [(7, "same text"), (12, "other "), (13, "third")]]
    rows = []
    for k, part in enumerate(parts):
        rows += part
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"docs/k={k}"))
        docs = dedup.located(spark.read.parquet(str(tmp_path / f"docs/k={k}")))
        dedup.fingerprints(docs).coalesce(1).write.mode("append").parquet(seen)
        if k:
            dedup.ingest(spark, seen, state, batch_bytes=1)
    batches = spark.read.parquet(f"{state}/entries").select("batch").distinct().count()
    assert batches == 3
    whole = dedup.located(spark.read.parquet(str(tmp_path / "docs")))
    found = dedup.entries(spark, state)
    assert told(dedup.decide(whole, spark.read.schema(dedup.SEEN).parquet(seen), found)) == brute(rows)
    before = sorted(map(str, found.collect()))
    dedup.ingest(spark, seen, state)
    assert sorted(map(str, dedup.entries(spark, state).collect())) == before


def test_clashing_digests_are_told_apart(spark):
    rows = [(k, f"text number {k % 50}") for k in range(200)]
    docs = dedup.located(frame(spark, rows))
    assert told(dedup.deduplicate(frame(spark, rows), digest_bytes=0)) == brute(rows)
    assert docs.count() == 200


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op12_exact_dedup(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql.ORACLES['op12_exact_dedup']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_no_python_on_executors(spark, sf_dir):
    plan = queries.op12_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
