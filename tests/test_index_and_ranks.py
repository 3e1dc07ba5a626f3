"""Segmented ranks, the vector index and keyed attempts against literal rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve, sampling, vector_index
from tessera.plans import registry
from tessera.streaming import logs

VEC = "vec_id long, embedding array<float>, cell string, part string, vector string, id string"


def vectors(n, size=16, hot=0, seed=1):
    made = np.random.default_rng(seed)
    centres = made.normal(size=(12, size))
    rows = [(k, (centres[k % 12] + 0.4 * made.normal(size=size)).astype(np.float32).tolist()) for k in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(hot)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "v", "i") for r in rows], VEC)


def brute(rows, queries, k):
    ids, block = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = []
    for q, v in queries:
        scores = block @ np.array(v, np.float64)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out += [(q, int(ids[j]), round(float(scores[j]), 9), r + 1) for r, j in enumerate(order)]
    return sorted(out)


def told(found):
    return sorted((r.query_id, r.id, round(r.score, 9), r.rank) for r in found.collect())


def test_index_certified_is_exact_and_recall_holds(spark):
    """A third of the rows are copies of one vector, and a part of a cell holds 64 rows."""
    rows = vectors(900, hot=400)
    corpus = frame(spark, rows)
    index = vector_index.build_index(corpus, part_rows=64)
    asked = [r for r in rows if r[0] % 50 == 0]
    want = brute(rows, asked, 3)
    assert told(index.search(frame(spark, asked), certified=True)) == want
    assert told(index.search(frame(spark, asked), probes=1, certified=True)) == want
    assert told(index.search(frame(spark, asked), probes=len(index.centres))) == want
    near = told(index.search(frame(spark, asked)))
    assert len({r[:2] for r in near} & {r[:2] for r in want}) >= 0.9 * len(want)
    assert index.rows.count() == len(rows) and index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 3 * 64
    assert index.probes < len(index.centres)


def test_index_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0])]
    index = vector_index.build_index(frame(spark, rows), k=2)
    got = told(index.search(frame(spark, rows), k=2, certified=True))
    assert got == brute([rows[0], rows[1], rows[6], rows[7]], [rows[0], rows[1], rows[6]], 2) + [(6, 1, 1.0, 2)] or {r[0] for r in got} == {1, 2, 6}
    assert index.rows.count() == 4
    assert told(vector_index.build_index(frame(spark, [])).search(frame(spark, rows[:2]))) == []


def test_index_query_recall(spark, sf_dir):
    """Recall of the calibrated index against the exact search, which has SQL."""
    exact = {(r.query_id, r.id) for r in registry.QUERIES["knn_top3"](spark, sf_dir).collect()}
    near = {(r.query_id, r.id) for r in registry.QUERIES["knn_index_top3"](spark, sf_dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_exact_search_in_blocks_agrees(spark):
    rows = vectors(60)
    assert told(retrieve.top_k(frame(spark, rows[:7]), frame(spark, rows), 3, block=2)) == brute(rows, rows[:7], 3)


GROUPED = [(k, None if k % 7 == 0 else f"g{min(k % 11, 3)}", (k * 37) % 101, k % 3) for k in range(300)]


def ranked(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = []
    for own in groups.values():
        own.sort(key=lambda r: (r[2], r[0]))
        total = 0
        for k, r in enumerate(own):
            total += r[3]
            out.append((r[0], k + 1, len(own), total))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_segmented_ranks_and_sums(spark, partitions):
    rows = spark.createDataFrame(GROUPED, "id long, g string, x long, v long").repartition(partitions)
    got = sampling.segmented(rows, ["g"], ["x", "id"], {"total": F.col("v")})
    assert sorted((r.id, r["__rank"], r["__n"], r.total) for r in got.collect()) == ranked(GROUPED)
    assert sampling.segmented(rows.limit(0), ["g"], ["x", "id"]).count() == 0


@pytest.mark.parametrize("n", [3, 2000])
def test_first_of_groups(spark, n):
    rows = spark.createDataFrame(GROUPED, "id long, g string, x long, v long")
    got = sampling.first_of_groups(rows, ["g"], ["x", "id"], n)
    assert sorted((r.id, r["__rank"]) for r in got.collect()) == sorted((i, k) for i, k, _, _ in ranked(GROUPED) if k <= n)


@pytest.mark.parametrize("name", ["round_robin_take", "representatives", "stratified_topk", "running_em", "search_budget", "refill_candidates"])
def test_no_window_takes_a_whole_group(spark, sf_dir, name):
    """Windows by source, data set, status or brand either limit their groups before the shuffle or are not there."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # Windows over the table of runs, and within runs, name their columns.
    wide = [x for x in plan.splitlines() if " Window [" in x and not any(c in x for c in ("__p#", "__c#", "__s0#"))]
    assert not wide or "WindowGroupLimit" in plan or name == "refill_candidates"


ATTEMPTS = "id string, at long, error string, em long"


def attempts(spark, rows):
    return spark.createDataFrame(rows, ATTEMPTS)


def states(rows):
    out = {}
    for key, at, error, em in sorted(rows, key=lambda r: r[1]):
        if key is None:
            continue
        s = out.setdefault(key, dict(done=False, em=None, last=None, failures=0))
        if error is None and not s["done"]:
            s.update(done=True, em=em, last=None)
        elif error is not None:
            s["failures"] += 1
            if not s["done"]:
                s["last"] = error
    return sorted((k, s["done"], s["em"], s["last"], s["failures"]) for k, s in out.items())


def read(table):
    return sorted((r.id, r.done, r.em, r.last_error, r.failures) for r in table.collect())


def test_attempts_go_on_from_the_checkpoint(spark, tmp_path):
    """Errors stay open over restarts, a trajectory ends an id for good, later attempts change nothing."""
    draw = random.Random(3)
    rows = [(f"id{draw.randrange(40)}" if draw.random() < 0.95 else None, k, "timeout" if draw.random() < 0.8 else None, k % 2) for k in range(400)]
    parts = [rows[:150], rows[150:300], rows[300:]]
    folder, log = str(tmp_path / "run"), str(tmp_path / "log")
    for k, part in enumerate(parts):
        attempts(spark, part).repartition(3).write.mode("append").parquet(log)
        stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 2).parquet(log)
        logs.follow_attempts(stream, "id", ["at"], "error", folder).awaitTermination()
        table = logs.followed(spark, folder, "id", ["em"])
        assert read(table) == states([r for p in parts[: k + 1] for r in p])
    wanted = spark.createDataFrame([(f"id{k}", "q") for k in range(45)], "id string, question string")
    left = {r.id: (r.last_error, r.failures) for r in logs.still_open(wanted, table, "id").collect()}
    done = {s[0] for s in states(rows) if s[1]}
    assert left == {f"id{k}": next(((s[3], s[4]) for s in states(rows) if s[0] == f"id{k}"), (None, 0)) for k in range(45) if f"id{k}" not in done}


def test_attempts_of_a_table_and_an_empty_stream(spark, tmp_path):
    rows = [("a", 1, "x", 0), ("a", 2, None, 1), ("a", 3, None, 0), ("b", 1, "y", 0), ("b", 2, "z", 0), (None, 1, None, 1)]
    assert read(logs.attempt_table(logs.attempt_states(attempts(spark, rows), "id", ["at"], "error"), "id", ["em"])) == states(rows)
    attempts(spark, []).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(ATTEMPTS).parquet(str(tmp_path / "log"))
    logs.follow_attempts(stream, "id", ["at"], "error", str(tmp_path / "run")).awaitTermination()
    assert read(logs.followed(spark, str(tmp_path / "run"), "id", ["em"])) == []


def literal_refill(rows, taken, rejected, n):
    """Groups take turns in order; a group takes its first row whose question nobody has, until n rows or nothing is left."""
    groups = {}
    for key, group, question in sorted(rows):
        groups.setdefault(group, []).append((key, question))
    held, out = set(taken) | set(rejected), []
    while len(out) < n:
        before = len(out)
        for group in sorted(groups):
            pick = next((r for r in groups[group] if r[1] not in held), None)
            if pick and len(out) < n:
                held.add(pick[1])
                groups[group].remove(pick)
                out.append(pick[0])
        if len(out) == before:
            break
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 7), (3, 40), (4, 400)])
def test_refill_against_turns_taken_one_by_one(spark, seed, n):
    """Few questions in many groups: most are taken by another group when a group's turn comes."""
    from tessera.operators import coverage

    draw = random.Random(seed)
    rows = [(k, f"g{draw.randrange(6)}", f"q{draw.randrange(60)}") for k in range(300)]
    selected, rejected = [(900, "q1"), (901, "q2")], ["q3", "q4"]
    frame = spark.createDataFrame(rows, "id long, group_id string, question string")
    told = spark.createDataFrame(selected, "id long, question_key string")
    gone = spark.createDataFrame([(q,) for q in rejected], "question_key string")
    got = coverage.refill(frame, told, gone, F.col("question"), n, F.col("id"), F.col("group_id"))
    assert [r.id for r in got.collect()] == literal_refill(rows, ["q1", "q2"], rejected, n)
    assert got.columns == frame.columns
