import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, queries, sql

DOC = "doc_id long, text string, lang string, source string, size string, target string"


def test_targets_fill_up_capped_sources(spark):
    rows = [("a", 100), ("b", 1), ("c", 10), (None, 50)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["b"] == 3 and got["c"] == 30
    assert got["a"] == got[None] == pytest.approx((161 - 33) / 2)
    assert sum(got.values()) == pytest.approx(161)


def test_mix_edge_cases(spark):
    rows = [(k, "w " * (k % 7), "en", f"s{k % 3}", "clash", "clash") for k in range(300)]
    rows += [(None, "x y", None, None, None, None), (5, None, "en", "s0", "", ""), (5, None, "en", "s0", "", ""), (7, "w " * 5000, "en", "s1", "", ""), (8, "\n\t ", "en", "empty", "", "")]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
    assert target["empty"] == 0 and sum(target.values()) == pytest.approx(sum(r.size for r in got))
    for s, t in target.items():
        assert abs(taken[s] - t) <= (5000 if s == "s1" else 12)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_empty_and_take(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    frame = spark.createDataFrame([(k, "a b", "en", f"s{k % 2}", "", "") for k in range(40)], DOC)
    mixed = mixing.mix(frame)
    assert mixing.take(frame).count() == mixed.agg(F.sum("copies")).first()[0]


def test_taken_words_come_near_targets(spark, sf_dir):
    got = queries.op1_mix_sources(spark, sf_dir)
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= 2 * r.most


@pytest.mark.parametrize("name", ["op1_mix_sources", "op10_chat_format"])
def test_queries_equal_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({sql.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, want))


CHAT = "conv_id long, turn long, role string, text string, formatted string, turns string"
NASTY = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|im_sep|>", "<\\\\|", "<|", "|<|\\|>", "", None, "a\nb", "$1\\1", "<|nl|>", "é漢😀" * 50]


def test_chat_round_trip(spark):
    rows = [(c, k // 2, ["user", "assistant", "assistant", None, "sys\n<|im_end|>\ntem"][(k + c) % 5], NASTY[(k * 3 + c) % len(NASTY)]) for c in range(4) for k in range(11)]
    rows += [(None, 0, "assistant", "null id"), (9, None, "user", "null turn"), (9, 1, "user", "x" * 100_000)] + [(8, 3, "assistant", "same")] * 4
    frame = spark.createDataFrame([(*r, "f", "t") for r in rows], CHAT)
    made = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        heads = re.findall(r"<\|im_start\|>(.*)\n", r.formatted)
        assert all(a != b for a, b in zip(heads, heads[1:], strict=False))


def test_chat_empty(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], CHAT))).count() == 0
