import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import coverage, merge, messages, packets, reports, retrieve, sampling
from tessera.sources import external, files
from tessera.streaming import logs


def greedy(table, target, quota):
    """The literal rule: one row at a time for the rarest label from the best group, then round robin."""
    freq = {}
    for g in table:
        for label in g["labels"]:
            freq[label] = freq.get(label, 0) + g["size"]
    ranked = sorted(table, key=lambda g: (-g["priority"], g["group_id"]))
    left, taken, count, total = {g["group_id"]: g["size"] for g in table}, {g["group_id"]: 0 for g in table}, dict.fromkeys(freq, 0), 0

    def take(g):
        nonlocal total
        left[g["group_id"]] -= 1
        taken[g["group_id"]] += 1
        total += 1
        for own in g["labels"]:
            count[own] += 1

    for label in sorted(freq, key=lambda x: (freq[x], x)):
        while count[label] < quota and total < target:
            found = next((g for g in ranked if label in g["labels"] and left[g["group_id"]]), None)
            if found is None:
                break
            take(found)
    while total < target and any(left.values()):
        for g in ranked:
            if left[g["group_id"]] and total < target:
                take(g)
    return {k: n for k, n in taken.items() if n}


@pytest.mark.parametrize("seed", range(40))
def test_quota_plan_equals_greedy(seed):
    rng = random.Random(seed)
    table = [{"group_id": f"g{k:02}", "size": rng.randint(1, 40), "priority": rng.choice([1.0, 2.0, rng.random()]), "labels": rng.sample("abcdefgh", rng.randint(1, 4))} for k in range(rng.randint(1, 25))]
    target = rng.randint(1, 400)
    assert coverage.quota_plan(table, target) == greedy(table, target, max(24, min(80, target // 100)))


def test_split_quotas():
    got = sampling.split_quotas({"a": 10, "b": 90, "c": 0}, 10)
    assert got == {"a": 1, "b": 9, "c": 0} and sum(sampling.split_quotas({"x": 3, "y": 2}, 10).values()) == 5


def test_cap_keeps_protected(spark):
    rows = spark.createDataFrame([(k, "s", k < 7, float(k)) for k in range(20)], "id long, sig string, protected boolean, rarity double")
    got = sampling.cap_per_group(rows, "sig", 4, [F.col("rarity").desc(), F.col("id")])
    assert {r.id for r in got.collect()} == set(range(7))
    assert {r.id for r in sampling.cap_per_group(rows.withColumn("protected", F.col("id") == 0), "sig", 4, [F.col("rarity").desc()]).collect()} == {0, 17, 18, 19}


def test_shards_are_contiguous(spark):
    got = sampling.contiguous_shards(spark.range(11).repartition(3), [F.col("id")], 3)
    assert [r.shard for r in got.orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 3
    assert [r.shard for r in sampling.contiguous_shards(spark.range(2), [F.col("id")], 5).orderBy("id").collect()] == [0, 1]


STEP = "steps array<struct<action:string,primary_skill:string,support_skills:array<string>,query:string,draft_answer:string,retrieved:string>>"


def step(action, skill, answer="", query="", retrieved="", support=()):
    return (action, skill, list(support), query, answer, retrieved)


def test_validation_and_cleaning(spark):
    good = [step("search", "look", query="q", retrieved="r"), step("answer", "look", "Paris")]
    bad = [step("search", "conflict-check"), step("answer", "nope", "x", support=["nope", "look"])]
    tail = [*good, step("answer", "conflict-check", "paris."), step("answer", "conflict-check", "Paris")]
    frame = spark.createDataFrame([(1, good, "The Paris"), (2, bad, "x"), (3, tail, "Paris"), (4, [], "")], f"id int, {STEP}, final string")
    legal = F.array(F.lit("look"), F.lit("conflict-check"))
    v = frame.select("id", merge.validation(F.col("steps"), F.col("final"), F.array(F.lit("paris")), F.array(F.lit("look")), legal).alias("v"), F.size(merge.cleaned_steps(F.col("steps"))).alias("n"), merge.retrieved_steps(F.col("steps")).alias("r")).orderBy("id").collect()
    assert v[0].v.passed and v[0].v.route_matches_candidates and v[0].r == 1
    assert not v[1].v.passed and v[1].v.unknown_skills == ["nope"] and v[1].v.support_only_primary_steps == [0]
    assert [r.n for r in v] == [2, 2, 2, 0] and not v[3].v.has_search


def test_repack_counts_and_reasons(spark):
    def chat(*roles):
        return [(r, "<skill>s1</skill> <search>q</search>" if r == "assistant" else "text") for r in roles]

    rows = [(1, chat("system", "user", "assistant", "user", "assistant")), (2, chat("assistant")), (3, chat("user")), (4, None), (5, [("user", "q"), ("assistant", "no tag")]), (6, [("user", "q"), ("assistant", "<skill>zz</skill>")]), (7, chat("user", "tool", "assistant"))]
    got = messages.repack_two_phase(spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>"), F.create_map(F.lit("s1"), F.lit("card")), F.lit("index")).orderBy("id").collect()
    assert [r.drop_reason for r in got] == [None, "assistant_without_user", "no_assistant_turns", "missing_messages", "missing_skill_tag", "unknown_skill", "unsupported_role_tool"]
    said = "<skill>s1</skill> <search>q</search>"
    assert [m.role for m in got[0].packed] == ["system"] + ["user", "assistant", "user", "assistant"] * 2 and all(r.packed is None for r in got[1:])
    assert got[0].packed[2].content == "<select_skill>s1</select_skill>" and got[0].packed[4].content == said and got[0].action_turns == 2
    assert '<skill_card id="s1">\ncard\n</skill_card>' in got[0].packed[3].content


def test_repack_looks_at_every_skill_and_turn_before(spark):
    one, two = "<skill>s1</skill> a", "<skill> s1 | zz </skill> a"
    rows = [(1, [("system", "x"), ("assistant", one)]), (2, [("user", "q"), ("assistant", one), ("assistant", one)]), (3, [("user", "q"), ("assistant", two)]), (4, [("user", "Recommended skills: a\nq\nStart with <skill>\nStop immediately after the closing tag."), ("assistant", one)])]
    got = messages.repack_two_phase(spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>"), F.create_map(F.lit("s1"), F.lit("card")), F.lit("index")).orderBy("id").collect()
    assert [r.drop_reason for r in got] == ["assistant_without_user", "assistant_without_user", "unknown_skill", None]
    assert got[3].packed[1].content.startswith("q\n\nindex\n\n")


def test_turn_parsing(spark):
    rows = ["x <search> a\nb </search> y <answer>z</answer>", "<ANSWER> z </ANSWER> tail", "plain", "<search>open", "/search"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(messages.parse_turn(F.col("t")).alias("p"), messages.prediction(F.col("t"), F.col("t")).alias("a")).collect()
    assert (got[0].p.action, got[0].p.query, got[0].p.kept, got[0].a) == ("search", "a\nb", "x <search> a\nb </search>", "z")
    assert (got[1].p.action, got[1].p.kept, got[1].a) == ("final", "<ANSWER> z </ANSWER>", "z")
    assert [r.a for r in got[2:]] == ["plain", "", ""]


def test_render(spark):
    got = spark.createDataFrame([("x", None)], "a string, b string").select(messages.render("{a}: {json} {b}{a", a=F.col("a"), b=F.col("b"))).first()[0]
    assert got == "x: {json} {a"


def test_bank(spark):
    text = "# Bank\n`alpha`\nfirst line\nsecond\n`beta`\n\n`alpha`\nagain `beta` inside"
    lines = spark.createDataFrame([("b", k, x) for k, x in enumerate(text.split("\n"))], "doc string, line_no int, value string")
    assert {r.skill_id: r.text for r in packets.parse_bank(lines).collect()} == {"alpha": "again `beta` inside"}
    assert {r.skill_id: r.text for r in packets.parse_bank(lines, keep_empty=True).collect()} == {"alpha": "again `beta` inside", "beta": ""}
    ids = spark.range(1).select(packets.bank_ids(F.lit(text), True).alias("a"), packets.bank_ids(F.lit("`b` `a` `b`")).alias("b")).first()
    assert ids.a == ["alpha", "beta"] and ids.b == ["a", "b"]
    assert packets.skill_index(packets.parse_bank(lines), 8).first().index_text.split("\n")[1:] == ["- alpha: again `b..."]


@pytest.mark.parametrize("round_no", [1, 2, 3, 4])
def test_bucket_rules(spark, round_no):
    schema = "native_type string, flags array<string>, entity_bin string, token_bin string, hop_count int, wh_word string, form string"
    rows = [("bridge", ["temporal", "dense_entities", "relation_chain"], "dense_entity", "very_long", 4, "when", "number"), ("decomp_2", [], "single_entity", "short", 1, "other", "boolean")]
    got = spark.createDataFrame(rows, schema).select(F.array_join(tx.choices(*packets.bucket_rules(round_no)), "|")).collect()
    assert got[0][0] and len(packets.bucket_rules(round_no)) == 10


def test_merges(spark):
    rows = [("a", True, False, 1, 3, 1, 0), ("a", True, False, 0, 9, 1, 1), ("a", False, False, 0, 1, 1, 2), ("b", False, True, 0, 1, 1, 3), ("b", False, False, 1, 1, 1, 4)]
    got = merge.merge_runs(spark.createDataFrame(rows, "id string, passed boolean, runtime_error boolean, source int, n_steps int, n_outputs int, arrival int"))
    assert {(r.id, r.arrival, r.first_arrival) for r in got.collect()} == {("a", 1, 0), ("b", 4, 3)}
    rows = [("d", "1", "x", 0, False), ("d", "1", "y", 1, True), ("d", "1", "z", 2, True), ("d", "2", "z", 2, False)]
    best, log = merge.merge_canonical(spark.createDataFrame(rows, "dataset string, id string, source string, source_priority int, passed boolean"), [F.col("passed")])
    assert {(r.id, r.source) for r in best.collect()} == {("1", "y"), ("2", "z")}
    assert {(r.kept, r.replaced) for r in log.collect()} == {("y", "x"), ("y", "z")}


def test_knn_blocks_agree(spark):
    rows = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(40)], "vec_id long, embedding array<float>")
    one = {tuple(r) for r in retrieve.top_k(rows.where("vec_id < 7"), rows, 3).collect()}
    assert one == {tuple(r) for r in retrieve.top_k(rows.where("vec_id < 7"), rows.repartition(5), 3, block=2).collect()} and len(one) == 21


def test_metrics(spark):
    rows = [(1, "a", 1, [("search", ["s"], "<SEARCH>q</SEARCH>"), ("answer", [], "<answer>x</answer>")]), (2, "a", 0, [("search", ["s"], "q"), ("answer", ["t"], "x")]), (3, "b", 1, [])]
    m = reports.eval_metrics(spark.createDataFrame(rows, "id int, d string, em int, steps array<struct<action:string,selected_skills:array<string>,generated:string>>"), "d")
    a = {r.d: r for r in m.collect()}
    assert (a["a"].em, a["a"].avg_search_steps, a["a"].tagged_final_turn_rate, a["a"].tagged_search_turn_rate) == (0.5, 1.0, 0.5, 0.5)
    assert reports.pooled(m).first().em == pytest.approx(2 / 3) and reports.macro_average(m).first()[0] == 0.75
    r = spark.range(1).select(reports.reward(F.lit(1), F.array(F.lit("Paris")), F.array(F.lit("in paris")), F.array(F.lit("q"), F.lit("q")), 0.2, 0.1)).first()[0]
    assert r == pytest.approx(1.1)


def test_json_recovery():
    assert external.json_object('```json\n{"a": {"b": "}"}} tail\n```') == '{"a": {"b": "}"}}'
    # The first brace opens the object; one that is not closed or not JSON fails.
    assert external.json_object('noise {"k": {"j": 1}} {"l": 2}') == '{"k": {"j": 1}}' and external.json_object('noise { x {"k": 1}') is None
    assert external.json_object("none") is None and external.json_object(None) is None
    assert external.json_object('a [1, 2] b', "whole") == "[1, 2]" and external.json_object('```json\n{"a": 1}\n```', "fenced") == '{"a": 1}'
    assert external.response_text({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}) == "a\nb"


def test_rollout_stops():
    assert external.run_one("q", lambda q, s: "<search> </search>", external.offline_retriever, 6)[1][-1]["action"] == "invalid_search"
    assert external.run_one("q", lambda q, s: "<search>x</search>", lambda q: 1 / 0, 6)[1][-1]["action"] == "retriever_error"
    said, steps = external.run_one("a b", lambda q, s: "<search>x</search>", external.offline_retriever, 3)
    assert said == "" and len(steps) == 3 and external.run_one("a b", external.offline_policy, external.offline_retriever, 6)[0] == "b"


def test_post_retries():
    calls = []

    class Busy(Exception):
        code = 503

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b'{"ok": 1}'

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return Answer()

    assert external.post_json("http://x", {}, wait=0, opener=opener) == {"ok": 1} and len(calls) == 3
    assert external.versioned("http://x/") == "http://x/v1" == external.versioned("http://x/v1")


def test_sources(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(["", *[json.dumps({"id": str(k), "q": f"é{k}"}) for k in range(50)], "  "]))
    got = files.read_jsonl(spark, str(path), "id string, q string", limit=10).orderBy("line_no").collect()
    assert [(r.id, r.line_no) for r in got] == [(str(k), k) for k in range(10)]
    assert files.eval_ids(spark, str(tmp_path / "none.jsonl"), tolerant=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.eval_ids(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(ValueError, match="unsupported"):
        files.read_tables(spark, ["x.csv"])
    frame = spark.createDataFrame([("a", True), ("b", None)], "dataset string, passed boolean")
    files.write_partitioned(frame, str(tmp_path / "out"), "dataset", F.col("passed"))
    assert spark.read.parquet(str(tmp_path / "out/filtered")).count() == 1 and spark.read.parquet(str(tmp_path / "out/failed")).count() == 1
    made = []
    for _ in range(2):
        assert files.cached_table(spark, str(tmp_path / "cache"), lambda: made.append(1) or frame, expected=2).count() == 2
    assert made == [1]
    assert files.resolve_path("__ROOT__/x", {"ROOT": "/r"}) == "/r/x"


def test_arrow_source(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"id": ["a", "b", "c"], "n": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    assert [tuple(r) for r in files.read_tables(spark, [str(tmp_path / "x.arrow")]).select("id", "n").orderBy("id").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_streams(spark, tmp_path, sf_dir):
    rows = [{"id": str(k % 6), "dataset": "d", "passed": k % 2 == 0, "ts": f"2024-01-01T00:0{k % 6}:00"} for k in range(12)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "id string, dataset string, passed boolean, ts timestamp"
    stream = logs.read_log(spark, str(tmp_path / "log"), schema, 1)
    logs.append_log(logs.once_per_id(stream, "id", "ts"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.schema(schema).json(str(tmp_path / "out")).count() == 6
    logs.split_sink(stream, str(tmp_path / "split"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "split/failed")).count() == 6
    done = spark.createDataFrame([("1",)], "id string")
    assert logs.resume(spark.read.schema(schema).json(str(tmp_path / "log")), done, "id").count() == 10
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert logs.windowed_counts(events, "ts", "1 hour").agg(F.sum("n")).first()[0] == events.count()
    assert logs.sessions(events, "ts", "10 minutes").agg(F.sum("n")).first()[0] == events.count()
