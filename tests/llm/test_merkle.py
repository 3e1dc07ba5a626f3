import hashlib
import zlib

import duckdb
import pytest

from tessera.llm import common, merkle, queries, sql

DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos string, bucket string, h string, s string, m string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else text.translate({k: k + 32 for k in range(65, 91)})


def climb(nodes):
    """The root of a list of nodes, and each node's siblings on both sides, level by level."""
    at, sides = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            run, i = runs[p // 16], p % 16
            sides[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
        nodes, at = [H(*r) for r in runs], [p // 16 for p in at]
    return nodes[0], sides


def brute(rows):
    groups = {}
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        leaf = H(head, field(text))
        due = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        groups.setdefault(source, []).append((doc_id, leaf, H(head, field(lowered(text))) if due else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[s] = climb([x[1] for x in groups[s]])
    if not names:
        return []
    root, above = climb([tops[s][0] for s in names])
    out = []
    for s, outer in zip(names, above, strict=True):
        for (doc_id, leaf, f), inner in zip(groups[s], tops[s][1], strict=True):
            for left, right in inner + outer:
                f = H(left, f, right)
            out.append((doc_id, leaf, tops[s][0], root, H(*[a + b for a, b in inner + outer]), f, f == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "l", "p", "b", "h", "s", "m") for r in rows], DOC)


def told(frame):
    return sorted(map(tuple, frame.collect()), key=str)


ODD = [(5, "a", "en", 3, "ABC"), (None, "a", None, None, None), (None, None, "", 0, ""), (5, "a", "en", 3, "ABC"), (5, "a", "en", 3, "abd"), (7, "", "é", -1, "É漢 Z"), (8, "b:1", "x", 2**40, "Long TEXT " * 20_000), (0, "-", "-", 1, "-")]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [(1, None, None, None, None)], [(k, "one", "en", k, f"Text {k}") for k in range(17)], [(k, f"s{k}", "en", k, f"Text {k}") for k in range(40)]])
def test_against_brute_force(spark, rows):
    assert told(merkle.build(frame(spark, rows)).proofs()) == brute(rows)


def test_levels_above_the_buckets(spark, monkeypatch):
    """Buckets of 16 leaves, so that trees of 1 to 700 leaves have up to two levels above them, and small blocks."""
    rows = [(k * 3, f"s{j}", "en", k, f"Text {k} of {j}") for j, n in enumerate((1, 15, 16, 17, 256, 257, 700)) for k in range(n)]
    code = dict(BUCKET_LEVELS=1, BLOCK=40)
    for name, value in code.items():
        monkeypatch.setattr(merkle, name, value)
    nodes = merkle._NODES[:2]
    monkeypatch.setattr(merkle, "_NODES", nodes)
    monkeypatch.setattr(merkle, "_ROOTS", f"WITH {', '.join(nodes)} SELECT s, bucket, h AS root FROM n1")
    got = merkle.build(frame(spark, rows + ODD))
    proofs = told(got.proofs())
    assert proofs == brute(rows + ODD)
    assert {p[3] for p in proofs} == {got.root}


def test_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT", 3)
    rows = ODD + [(k, "hot" if k % 3 else f"s{k % 20}", "en", k, f"Text {k}") for k in range(600)]
    assert told(merkle.build(frame(spark, rows)).proofs()) == brute(rows)


def test_empty_table(spark):
    manifest = merkle.build(frame(spark, []))
    assert manifest.proofs().count() == 0 and manifest.root is None


def test_a_changed_leaf_is_found(spark):
    """Only texts with capitals change under tampering, and only their proofs fail."""
    rows = [(k, "a", "en", 1, "UPPER" if k % 2 else "lower") for k in range(60)]
    for r in merkle.build(frame(spark, rows)).proofs().collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op13_merkle_manifest(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql.ORACLES['op13_merkle_manifest']})").fetchall()
    assert told(got) == sorted(map(tuple, want), key=str)
