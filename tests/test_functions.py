import math
import re
import string

import pytest
from pyspark.sql import functions as F

from tessera.functions import profile, routing, text as tx

SAMPLES = ["The-Beatles", "An A-Team", "  a  THE an ", "Niño's \"été\"", "", "it’s", "the\tcat\n sat", "A.B.C.", "x" * 50, "3,000 men", "l'été à la plage", "theatre an"]


def values(spark, expr, rows):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").orderBy("k").select(expr(F.col("x"))).collect()]


def words(x):
    return " ".join(x.split())


def py_teacher(x):
    x = x.strip().lower().replace("’", "'")
    return words(re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in x if c not in string.punctuation)))


def py_eval(x):
    x = re.sub(r"\b(a|an|the)\b", " ", x.lower().strip())
    return words("".join(c for c in x if c not in string.punctuation))


def py_pack(x):
    x = x.strip().lower()
    for c in ".,!?;:'\"()[]{}-_`":
        x = x.replace(c, " ")
    return words(x)


@pytest.mark.parametrize(("column", "python"), [
    (tx.normalize_answer_teacher, py_teacher), (tx.normalize_answer_eval, py_eval), (tx.normalize_answer_pack, py_pack),
    (tx.normalize_question, lambda x: words(x).lower()), (tx.word_count, lambda x: len(x.split())),
    (tx.clean_prediction, lambda x: re.sub(r"^['\"]|['\"]$", "", x.strip()).strip()),
    (lambda c: tx.compact_text(c, 9), lambda x: words(x) if len(words(x)) <= 9 else words(x)[:9].rstrip() + "..."),
    (lambda c: tx.clip_text(c, 9), lambda x: x.strip() if len(x.strip()) <= 9 else x.strip()[:6].rstrip() + "..."),
])
def test_text_functions(spark, column, python):
    assert values(spark, column, SAMPLES) == [python(x) for x in SAMPLES]


def test_normalisers_diverge(spark):
    got = [values(spark, f, ["The-Beatles", "An A-Team"]) for f in (tx.normalize_answer_teacher, tx.normalize_answer_eval, tx.normalize_answer_pack)]
    assert got == [["thebeatles", "ateam"], ["beatles", "team"], ["the beatles", "an a team"]]


def test_null_text(spark):
    assert values(spark, tx.normalize_answer_eval, [None]) == [""] and values(spark, tx.word_count, [None]) == [0]


@pytest.mark.parametrize(("n", "types", "hops", "want"), [(90447, 2, 1, 12445), (15000, 4, 2, 8300), (19938, 3, 3, 8594), (100, 1, 1, 100)])
def test_target_sizes(spark, n, types, hops, want):
    assert spark.range(1).select(tx.target_size(F.lit(n), F.lit(types), F.lit(hops))).first()[0] == want


@pytest.mark.parametrize(("n", "least", "share", "want"), [(79168, 12, 0.002, 159), (78785, 12, 0.002, 158), (12445, 24, 0.003, 38), (8300, 24, 0.003, 25), (8594, 24, 0.003, 26), (10, 12, 0.002, 12)])
def test_rare_thresholds(spark, n, least, share, want):
    assert spark.range(1).select(tx.rare_threshold(F.lit(n), least, share)).first()[0] == want
    assert want == max(least, math.ceil(share * n))


def test_exact_match_variants(spark):
    rows = [("The Cat", ["cat"]), ("", [""]), ("dog", ["cat", "a dog"]), ("dog", None)]
    frame = spark.createDataFrame(rows, "p string, g array<string>")
    assert [r[0] for r in frame.select(tx.exact_match(F.col("p"), F.col("g"))).collect()] == [True, True, True, False]
    assert [r[0] for r in frame.select(tx.exact_match(F.col("p"), F.col("g"), teacher=True)).collect()] == [True, False, True, False]


def test_gold_answers(spark):
    frame = spark.createDataFrame([([], ["x ", ""]), (None, None), (["a"], ["b"])], "g array<string>, a array<string>")
    assert [r[0] for r in frame.select(tx.gold_answers(F.col("g"), F.col("a"))).collect()] == [["x"], [], ["a"]]


def test_profile_of_known_questions(spark):
    rows = [("Who is the director of the film Jaws?", "Steven Spielberg"), ("is a", ""), ("When was Niño born and in what country", "1975"), ('What is "X"?', "yes")]
    frame = spark.createDataFrame(rows, "q string, a string").select(
        profile.wh_word(F.col("q")).alias("wh"), profile.answer_form(F.col("a")).alias("form"), profile.entity_count(F.col("q")).alias("spans"), profile.single_flags(F.col("q"), F.col("a")).alias("flags"), profile.suspicious(F.col("q"), F.col("a")).alias("odd"),
    )
    a, b, c, d = frame.collect()
    assert (a.wh, a.form, a.spans) == ("who", "entity_or_short_span", 2) and a.flags == ["direct_lookup", "person", "title_work"]
    assert b.odd == ["empty_answer", "non_interrogative_fragment", "too_few_tokens", "very_short_text"] or "empty_answer" in b.odd
    assert c.form == "year_or_date" and {"temporal", "numeric", "location"} <= set(c.flags)
    assert d.form == "boolean" and "quoted_span" in d.flags


def test_canonical_json_spacing(spark):
    got = spark.range(1).select(tx.canonical_json({"b": ("number", F.lit(2)), "a": ("text", F.lit('x"y')), "c": ("texts", F.array(F.lit("p"), F.lit("q")))})).first()[0]
    assert got == '{"a": "x\\"y", "b": 2, "c": ["p", "q"]}'


LEGAL = ["bridge-entity-search", "relation-chain-decomposition", "single-entity-relation-lookup", "surface-name-resolution", "superlative-ranking-match", "temporal-range-extract", "answer-grounding-check", "conflict-check", "parallel-attribute-compare", "multihop-yes-no-verification", "multi-constraint-query-anchoring", "sequential-hop-checkpointing"]


def test_routers(spark):
    legal = F.array(*[F.lit(s) for s in LEGAL])
    frame = spark.createDataFrame([("Who is also known as X?", "nq"), ("Are both films older than the company of the director of Y?", "hotpotqa"), ("Xyz", "nq")], "q string, d string")
    q = F.col("q")
    rows = frame.select(routing.question_type(q).alias("t"), routing.initial_skills(q, legal).alias("i"), routing.primary_skills(q, F.lit("unknown"), F.col("d"), F.lit(1), legal).alias("p")).collect()
    assert rows[0].t == "alias" and rows[0].i[0] == "surface-name-resolution" and rows[0].p[0] == "surface-name-resolution"
    assert rows[1].t == "yesno" and rows[1].i == ["multihop-yes-no-verification", "parallel-attribute-compare", "bridge-entity-search", "relation-chain-decomposition", "conflict-check"]
    assert rows[2].t == "fact" and rows[2].i == ["single-entity-relation-lookup", "answer-grounding-check"] and rows[2].p == ["single-entity-relation-lookup"]


def test_budget_and_names(spark):
    frame = spark.createDataFrame([("short?", "nq", None), ("both " * 20, "x", None), ("q", "x", 9), ("a " * 13, "nq", 0)], "q string, d string, b int")
    assert [r[0] for r in frame.select(routing.search_budget(F.col("q"), F.col("d"), F.col("b"))).collect()] == [2, 5, 5, 3]
    assert [r[0] for r in spark.createDataFrame([("2wiki",), ("",), (None,), ("nq",)], "d string").select(routing.dataset_name(F.col("d"))).collect()] == ["2wikimultihopqa", "unknown", "unknown", "nq"]
