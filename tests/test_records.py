"""Sources, JSON recovery, strict joins, and functions that no query reaches, against literal rules."""

import itertools
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import merge, messages, packets, reports
from tessera.sources import arrow_ipc, external, files


def texts_with_braces(n, seed):
    draw = random.Random(seed)
    pieces = ['{', '}', '"', "\\", '\\"', "\\\\", "a", " ", '"k": ', "1", ",", '{"a": 1}', '"x } y"', '"\\u00e9"', "\n", "é", "[2]", "```", "```json\n", "null", '{"b": {"c": "}\\""}}']
    return ["".join(draw.choices(pieces, k=draw.randrange(14))) for _ in range(n)] + [None, "", '{"a": "' + "x" * 100_000 + '\\"}' * 3_000 + '"} tail', "{" * 3_000 + "}" * 3_000]


def literal_object(text):
    """The rule as it is stated: depth and string state, a character at a time."""
    at = (text or "").find("{")
    if at < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for k in range(at, len(text)):
        c = text[k]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at : k + 1]
    return None


def test_first_object_against_the_literal_rule(spark):
    texts = texts_with_braces(3000, 1)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = dict(rows.select("k", external.first_object(F.col("t"))).collect())
    assert [got[k] for k in range(len(texts))] == [literal_object(t) for t in texts]


@pytest.mark.parametrize("how", ["first", "whole", "fenced"])
def test_recovered_json_equals_the_parser(spark, how):
    texts = texts_with_braces(1500, 2) + ['{"a": 1} x', '```json\n{"a": [1, {"b": "}"}]}\n```', 'x {"z": 1, "a": 2} {', "12", "[1, 2]", 'pre [1, 2] post', 'pre {"a": 1} mid {"b": 2} post', '{"a": 1}']
    texts = [t for t in texts if t is None or len(t) < 5000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = dict(rows.select("k", external.recover_json(F.col("t"), how)).collect())
    for k, t in enumerate(texts):
        want = external.json_object(t, how)
        assert (got[k] is None) == (want is None), t
        assert want is None or json.loads(got[k]) == json.loads(want), t


def test_unknown_way_is_refused():
    with pytest.raises(ValueError, match="no way"):
        external.recover_json(F.lit("x"), "other")


LIGHT, FULL = "id string, question string, x int", "id string, question string, y int"


@pytest.mark.parametrize(
    ("light", "full", "fault"),
    [
        ([("a", "q", 1)], [("a", "q", 1), ("b", "q", 2)], "1 light rows and 2 full rows"),
        ([("a", "q", 1), ("b", "q", 1)], [("a", "q", 1), ("a", "q", 2)], "'a' stands 2 times"),
        ([("a", "q", 1), ("b", "q", 1)], [("a", "q", 1), (None, "q", 2)], "without|no key"),
        ([("a", "q", 1), ("b", "q", 1)], [("a", "q", 1), ("c", "q", 2)], "key 'b': no full row"),
        ([("a", "q", 1), (None, "q", 1)], [("a", "q", 1), ("c", "q", 2)], "no full row"),
        ([("a", "q", 1), ("b", "other", 1)], [("a", "q", 1), ("b", "q", 2)], "key 'b': another question"),
    ],
)
def test_strict_join_tells_each_fault(spark, light, full, fault):
    with pytest.raises(ValueError, match=fault):
        merge.join_strictly(spark.createDataFrame(light, LIGHT), spark.createDataFrame(full, FULL))


def test_strict_join_of_good_rows(spark):
    """Questions are stripped, a missing one is the other's; a light key may come twice if the numbers agree."""
    light = [("a", " q", 1), ("b", None, 2), ("c", "r", 3), ("c", "r", 4)]
    full = [("a", "q ", 1), ("b", "x", 2), ("c", None, 3), ("d", "unused", 4)]
    got = merge.join_strictly(spark.createDataFrame(light, LIGHT), spark.createDataFrame(full, FULL)).select("light.id", "light.x", "full.y").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("c", 4, 3)]
    assert merge.join_strictly(spark.createDataFrame([], LIGHT), spark.createDataFrame([], FULL)).count() == 0


def arrow_table(n, dictionary=False):
    names = pa.array([f"é{k % 5}" if k % 7 else None for k in range(n)])
    return pa.table({"id": pa.array(range(n), pa.int64()), "name": names.dictionary_encode() if dictionary else names, "parts": pa.array([[k, k + 1] for k in range(n)], pa.list_(pa.int64()))})


def write_arrow(path, table, kind, rows=20):
    with (pa.ipc.new_stream if kind == "stream" else pa.ipc.new_file)(str(path), table.schema) as out:
        out.write_table(table, max_chunksize=rows)


@pytest.mark.parametrize(("kind", "dictionary"), list(itertools.product(["stream", "file"], [False, True])))
def test_arrow_is_split_into_tasks(spark, tmp_path, kind, dictionary):
    table = arrow_table(500, dictionary)
    write_arrow(tmp_path / "x.arrow", table, kind)
    size = (tmp_path / "x.arrow").stat().st_size
    rows = files.read_arrow(spark, f"file://{tmp_path}/x.arrow", split_bytes=size // 6)
    assert rows.rdd.getNumPartitions() >= 6
    assert sorted((r.id, r.name, r.parts) for r in rows.collect()) == [(r["id"], r["name"], r["parts"]) for r in table.to_pylist()]
    per_task = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per_task) >= 4 and sum(per_task) == 500


def test_arrow_folders_and_faults(spark, tmp_path):
    (tmp_path / "f").mkdir()
    write_arrow(tmp_path / "f/a.arrow", arrow_table(30), "stream")
    write_arrow(tmp_path / "f/b.arrow", arrow_table(12), "file")
    (tmp_path / "f/_SUCCESS").write_text("")
    assert files.read_arrow(spark, str(tmp_path / "f"), 300).count() == 42
    assert files.read_tables(spark, [str(tmp_path / "f/b.arrow"), str(tmp_path / "f/a.arrow")]).groupBy("src_priority").count().orderBy("src_priority").collect()[0]["count"] == 12
    write_arrow(tmp_path / "f/empty.arrow", arrow_table(0), "stream")
    assert files.read_arrow(spark, str(tmp_path / "f/empty.arrow")).count() == 0
    write_arrow(tmp_path / "f/z.arrow", pa.table({"other": [1]}), "file")
    with pytest.raises(Exception, match="another schema"):
        files.read_arrow(spark, str(tmp_path / "f")).count()
    with pytest.raises(Exception, match="FileNotFoundError|none"):
        files.read_arrow(spark, str(tmp_path / "none")).count()
    whole = (tmp_path / "f/a.arrow").read_bytes()
    (tmp_path / "cut.arrow").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(EOFError, match="cut off"):
        list(arrow_ipc.read_split(arrow_ipc.Split(str(tmp_path / "cut.arrow"), 0, len(whole))))


def test_files_of_the_driver(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert files.read_config(str(tmp_path / "c.json")) == {"a": [1]}
    rows = spark.createDataFrame([(1, "é")], "id int, t string")
    files.write_jsonl(rows, str(tmp_path / "j"))
    files.write_jsonl(rows, str(tmp_path / "j"), append=True)
    assert [r.t for r in spark.read.json(str(tmp_path / "j")).collect()] == ["é", "é"]
    report = files.write_report(rows.select(F.struct("id", "t").alias("x")), str(tmp_path / "r.json"))
    assert report == json.loads((tmp_path / "r.json").read_text()) == {"x": {"id": 1, "t": "é"}} and "é" in (tmp_path / "r.json").read_text()
    nested = messages.prompt_rows(spark.createDataFrame([("7", "who", ["x"], "nq")], "id string, question string, golden_answers array<string>, dataset string"), "train", "Answer.")
    files.write_nested(nested, str(tmp_path / "n"))
    (r,) = spark.read.parquet(str(tmp_path / "n")).collect()
    assert r.prompt[0].role == "user" and r.prompt[0].content == "Answer.\nwho?" and r.reward_model.ground_truth.target == ["x"]
    assert (r.extra_info.split, r.extra_info["index"], r.extra_info.source_id) == ("train", 0, "7") and r.ability == "fact-reasoning"


def test_rows_by_outcome(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, passed boolean")
    good, bad = merge.split_passed(rows)
    assert ([r.id for r in good.collect()], sorted(r.id for r in bad.collect())) == ([1], [2, 3])
    (r,) = merge.runtime_failure(rows.where("id = 1"), F.lit("TimeoutError"), F.lit("late")).collect()
    assert r.validation.asDict() == {"passed": False, "runtime_error": True, "error_type": "TimeoutError", "error_message": "late"}
    shards = spark.createDataFrame([(10, 0, "c"), (2, 1, "e"), (2, 0, "d"), (1, 0, "a")], "shard int, idx int, v string")
    assert [r.v for r in merge.merge_shards(shards).collect()] == ["a", "c", "d", "e"]


def test_numbers_and_summaries(spark):
    rows = spark.createDataFrame([(0.125,), (0.125,)], "x double")
    assert rows.agg(reports.rounded_mean(F.col("x"))).first()[0] == 0.12
    said = spark.createDataFrame([("Who is the king of X?", "king of X"), ("a", "b"), ("", "")], "q string, s string")
    assert [round(r[0], 6) for r in said.select(reports.query_copy(F.col("q"), F.col("s"))).collect()] == [round(3 / 5, 6), 0.0, 1.0]
    text = packets.render_summary([{"bucket": "b", "matched_packet_count": 1, "total_group_size": 2, "examples": "x|y"}, {"bucket": "a", "matched_packet_count": 3, "total_group_size": 9, "examples": None}])
    assert text.splitlines() == ["# Packet summary", "", "## a", "- packets: 3", "- rows: 9", "", "## b", "- packets: 1", "- rows: 2", "- x", "- y"]


def test_packets_of_signatures(spark):
    rows = [("d", "s1", "1", "Who?", "a"), ("d", "s1", "2", " Who? ", "b"), ("d", "s1", "3", "When?", "c"), ("d", "s2", "4", "", "e"), ("d", "s2", "5", None, "f")]
    made = packets.build_packets(spark.createDataFrame(rows, "dataset string, signature string, id string, question string, primary_answer string"), [F.col("id")])
    got = {r.signature: r for r in made.collect()}
    assert got["s1"].group_size == 3 and [e.id for e in got["s1"].representative_examples] == ["1", "3"]
    assert got["s2"].group_size == 2 and got["s2"].representative_examples is None and got["s1"].group_id.startswith("d_sig_")


def test_documents_of_a_retriever(spark):
    docs = [{"document": {"contents": '"T"\nbody\nmore '}}, {"title": "U", "text": ["a", "b"]}, {"title": "V", "content": "c"}]
    assert external.passage_lines(docs) == 'Doc 1(Title: "T") body\nmore \nDoc 2(Title: U) a b\nDoc 3(Title: V) c'
    assert external.passage_lines(docs, True) == 'Doc 1(Title: "T") body\nmore\nDoc 2(Title: "U") a b\nDoc 3(Title: "V") c'
    kind = "struct<contents:string,title:string,text:array<string>>"
    rows = spark.createDataFrame([(("T\nbody", None, None),), ((None, "U", ["a", "b"]),), (("only",) + (None, None),)], f"d {kind}")
    assert [tuple(r[0]) for r in rows.select(messages.split_contents(F.col("d"))).collect()] == [("T", "body"), ("U", "a b"), ("only", "")]


def test_texts_of_nested_responses(spark):
    assert external.leaf_texts({"output_text": " told ", "output": []}) == " told "
    assert external.leaf_texts({"output": [{"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "no"}, {"type": "text", "text": "b "}]}]}) == "ab"
    rows = spark.createDataFrame([(json.dumps({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}),), (None,)], "r string")
    assert [r[0] for r in rows.select(external.gather_text(F.col("r"))).collect()] == ["a\nb", ""]


class Service(BaseHTTPRequestHandler):
    seen = []

    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, sent, self.headers.get("Authorization")))
        told = {"output": [{"content": [{"text": "said"}]}]} if self.path == "/v1/responses" else {"result": [[{"document": {"contents": f"T\n{q}"}} for q in sent["queries"]]]}
        body = json.dumps(told).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_services_over_http(service):
    assert external.http_retriever(service, k=5)("q") == "Doc 1(Title: T) q"
    assert external.http_model(service, "key", model="m")("sys", "usr") == "said"
    (path, sent, _), (model_path, asked, bearer) = Service.seen
    assert (path, sent) == ("/retrieve", {"queries": ["q"], "topk": 5, "return_scores": True})
    assert model_path == "/v1/responses" and bearer == "Bearer key" and [m["role"] for m in asked["input"]] == ["system", "user"]


def test_teacher_runs_in_tasks(spark):
    rows = spark.createDataFrame([("1", "nq", "capital of X", ["a"]), ("2", "nq", None, None)], "id string, dataset string, question string, candidate_primary_skills array<string>")
    got = {r.id: r for r in external.teacher_rollout(rows).collect()}
    first = got["1"]
    assert [s.action for s in first.steps] == ["search", "answer", "answer"] and first.final_answer == "X" and first.error_type is None
    assert first.steps[0].retrieved == "X of capital" and first.steps[2].primary_skill == external.FINAL_SKILL and len(first.raw_outputs) == 3

    def broken(system, user):
        raise TimeoutError("late")

    failed = external.teacher_rollout(rows, model=broken).collect()
    assert {(r.error_type, r.error_message) for r in failed} == {("TimeoutError", "late")}


def test_taught_records_keep_their_row_and_are_judged(spark):
    schema = "id string, dataset string, sample_origin string, question string, gold_answers array<string>, candidate_primary_skills array<string>, metadata_summary struct<hops:int>, steps string"
    rows = [
        ("1", "nq", "train", "capital of X", ["the x"], ["single-entity-relation-lookup"], (2,), "clash"),
        ("2", "nq", "replay", "capital of X", ["Y"], None, None, None),
        ("3", "nq", "train", "fails", None, [], None, None),
    ]

    def model(system, user):
        if "fails" in user:
            raise TimeoutError("late")
        return external.offline_model(system, user)

    legal = F.array(*[F.lit(x) for x in ("single-entity-relation-lookup", "answer-grounding-check", "conflict-check", external.FINAL_SKILL)])
    made = external.taught_records(spark.createDataFrame(rows, schema).drop("steps"), legal, model)
    got = {r.id: r for r in made.collect()}
    assert [(got[k].sample_origin, got[k].metadata_summary) for k in "123"] == [("train", got["1"].metadata_summary), ("replay", None), ("train", None)] and got["1"].metadata_summary.hops == 2
    one, two, three = (got[k].validation for k in "123")
    assert one.em and one.passed and one.has_search and one.route_matches_candidates and not one.runtime_error
    assert not two.em and not two.passed and two.unknown_skills == []
    assert three.runtime_error and not three.passed and three.em is None and (three.error_type, three.error_message) == ("TimeoutError", "late")
    assert got["3"].steps == [] and len(got["1"].steps) == 3
