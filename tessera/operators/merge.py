"""Trajectory validation, merging and failure records (survey M1-M7, W21, W25, A8, A11, A14, J14, J15, U1-U4, P26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import routing, text as tx
from tessera.session import written


def last_step(steps: Column) -> Column:
    """W25."""
    return F.try_element_at(steps, F.lit(-1))


def retrieved_steps(steps: Column) -> Column:
    """Search or verify steps that brought something."""
    return F.size(F.filter(steps, lambda s: F.lower(s["action"]).isin("search", "verify") & (F.trim(F.coalesce(s["retrieved"], F.lit(""))) != "")))


def validation(steps: Column, final_answer: Column, gold: Column, candidates: Column, legal: Column) -> Column:
    """The validation struct of a trajectory."""
    support = F.array(*[F.lit(s) for s in routing.SUPPORT_ONLY])
    used = F.concat(F.transform(steps, lambda s: F.coalesce(s["primary_skill"], F.lit(""))), F.flatten(F.transform(steps, lambda s: F.coalesce(s["support_skills"], F.array().cast("array<string>")))))
    unknown = F.array_sort(F.filter(F.array_except(used, legal), lambda s: s != ""))
    wrong = F.filter(F.transform(steps, lambda s, i: F.when((s["action"] != "answer") & F.array_contains(support, F.coalesce(s["primary_skill"], F.lit(""))), i)), lambda i: i.isNotNull())
    em, search = tx.exact_match(final_answer, gold, teacher=True), F.exists(steps, lambda s: s["action"].isin("search", "verify"))
    first = F.coalesce(F.try_element_at(steps, F.lit(1))["primary_skill"], F.lit(""))
    passed = em & search & (F.size(unknown) == 0) & (F.size(wrong) == 0)
    return F.struct(em.alias("em"), search.alias("has_search"), unknown.alias("unknown_skills"), wrong.alias("support_only_primary_steps"), F.array_contains(candidates, first).alias("route_matches_candidates"), passed.alias("passed"))


def cleaned_steps(steps: Column) -> Column:
    """Drop trailing answer steps of support-only skills that repeat the answer of the step before."""
    support = F.array(*[F.lit(s) for s in routing.SUPPORT_ONLY])
    norm = F.transform(steps, lambda s: tx.normalize_answer_pack(s["draft_answer"]))

    def kept(n: Column) -> Column:
        repeats = F.transform(
            steps,
            lambda s, i: (i > 0) & (s["action"] == "answer") & (F.get(steps, F.greatest(i - 1, F.lit(0)))["action"] == "answer") & (F.get(n, i) != "") & (F.get(n, i) == F.get(n, F.greatest(i - 1, F.lit(0)))) & F.array_contains(support, s["primary_skill"]),
        )
        return F.size(steps) - F.coalesce(F.array_position(F.reverse(repeats), False) - 1, F.size(steps).cast("bigint"))

    return F.slice(steps, F.lit(1), F.transform(F.array(norm), kept)[0].cast("int"))


def merge_runs(runs: DataFrame, key: str = "id") -> DataFrame:
    """Of the runs of a key the best: passed, no runtime error, earlier source, fewer steps, more outputs, first.

    ``runs``: key, passed, runtime_error, source, n_steps, n_outputs, arrival and any other columns.
    """
    order = [F.col("passed").desc(), F.col("runtime_error").asc(), F.col("source").asc(), F.col("n_steps").asc(), F.col("n_outputs").desc(), F.col("arrival").asc()]
    by = Window.partitionBy(key)
    ranked = runs.withColumn("__rank", F.row_number().over(by.orderBy(*order))).withColumn("first_arrival", F.min("arrival").over(by))
    return ranked.where("__rank = 1").drop("__rank")


def quality_terms(validation_: Column, steps: Column, final_answer: Column, raw_outputs: Column, source_priority: Column) -> list[Column]:
    """M3: what makes one trajectory of a key better than another, the weightiest first; greater is better."""

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    def none(c: Column) -> Column:
        return F.coalesce(F.size(c) == 0, F.lit(True)).cast("int")

    n = F.coalesce(F.size(steps), F.lit(0))
    return [
        yes(validation_["passed"]), 1 - yes(validation_["runtime_error"]), (tx.strip(final_answer) != "").cast("int"), (n > 0).cast("int"),
        none(validation_["unknown_skills"]), none(validation_["support_only_primary_steps"]), yes(validation_["route_matches_candidates"]),
        -source_priority, F.coalesce(retrieved_steps(steps), F.lit(0)), n, F.coalesce(F.size(raw_outputs), F.lit(0)),
    ]


def merge_canonical(rows: DataFrame, quality: list[Column], keys: tuple[str, ...] = ("dataset", "id")) -> tuple[DataFrame, DataFrame]:
    """(the best row of each key over sources, the log of overlap decisions).

    ``rows`` have one row per key and source, with ``source_priority`` and ``source``; greater quality tuples win, ties
    stay with the earlier source. The log has one row per further source of a key, in order of sources.
    """
    scored = rows.withColumn("__q", F.struct(*[c.alias(f"q{i}") for i, c in enumerate(quality)], (-F.col("source_priority")).alias("own")))
    along = Window.partitionBy(*keys).orderBy("source_priority")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    judged = scored.withColumn("__best", F.max("__q").over(before)).withColumn("__held", F.max_by("source", "__q").over(before))
    log = judged.where(F.col("__held").isNotNull()).select(
        *keys, F.when(F.col("__q") > F.col("__best"), F.col("source")).otherwise(F.col("__held")).alias("kept"), F.when(F.col("__q") > F.col("__best"), F.col("__held")).otherwise(F.col("source")).alias("replaced")
    )
    chosen = scored.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__q").desc()))).where("__rank = 1")
    return chosen.drop("__q", "__rank"), log


def join_profiles(full: DataFrame, light: DataFrame, key: str, order: Column) -> DataFrame:
    """Full records with the profile fields that they lack; of light rows with one key the last in ``order`` counts.

    A field that both have is the full record's, whatever its value.
    """
    extra = [c for c in light.columns if c == key or c not in full.columns]
    last = light.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*extra), order).alias("__light"))
    joined = full.join(last, F.col(key) == F.col("__key"), "left")
    return joined.select(*full.columns, *[F.col("__light").getField(c).alias(c) for c in extra if c != key])


def join_strictly(light: DataFrame, full: DataFrame, key: str = "id", question: str = "question") -> DataFrame:
    """Light rows, in full: struct columns ``light`` and ``full`` by key; a written table.

    Raises ValueError if the numbers of rows differ, a full key is missing or repeated, a light key has no full row, or
    the questions of a pair differ; a missing question counts as equal to the other's. Each side is read once, for one
    join that keeps what has no partner and is written; the checks read its narrow columns alone. (Observed metrics
    would save that pass, but count twice what a lost executor computes again.)
    """
    a = light.select(F.struct(*light.columns).alias("light"), F.col(key).cast("string").alias("key"))
    b = full.select(F.struct(*full.columns).alias("full"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("full_key"))
    # Both sides are dealt out by the key once: for the count of each full key, and for the join.
    counted = b.groupBy("full_key").agg(F.count(F.lit(1)).alias("times"), F.first("full").alias("full"))
    joined = a.join(counted, F.col("key") == F.col("full_key"), "full_outer")
    theirs = tx.strip(F.coalesce(F.col("full")[question], F.col("light")[question]))
    mine = tx.strip(F.coalesce(F.col("light")[question], theirs))
    fault = F.when(F.col("light").isNotNull(), F.when(F.col("full_key").isNull(), "no full row").when(mine != theirs, "another question"))
    held = written(joined.withColumn("fault", fault), "joined-strictly")
    per_key = held.where(F.col("full_key").isNotNull()).groupBy("full_key").agg(F.max("times").alias("times"))
    repeated = F.when((F.col("times") > 1) | (F.col("full_key") == ""), F.struct("full_key", "times"))
    told = per_key.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n_full"), F.min(repeated).alias("odd")).first()
    lights = held.where(F.col("light").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("fault").isNotNull(), F.struct("key", "fault"))).alias("wrong")).first()
    if lights.n != told.n_full:
        raise ValueError(f"{lights.n} light rows and {told.n_full} full rows")
    if told.odd:
        raise ValueError(f"full key {told.odd.full_key!r} stands {told.odd.times} times" if told.odd.full_key else "a full row has no key")
    if lights.wrong:
        raise ValueError(f"key {lights.wrong.key!r}: {lights.wrong.fault}")
    return held.where(F.col("light").isNotNull()).select("light", "full")


def split_passed(rows: DataFrame, passed: str = "passed") -> tuple[DataFrame, DataFrame]:
    """Rows that passed and those that did not (null counts as not)."""
    good = F.coalesce(F.col(passed), F.lit(False))
    return rows.where(good), rows.where(~good)


def failure_replays(traces: DataFrame, dataset: str) -> DataFrame:
    """M4: failed traces (id, question, prediction, em, steps) as manifest rows with their wrong skills and error tag."""
    failed = traces.where(F.coalesce(F.col("em").cast("int"), F.lit(0)) != 1)
    skills = tx.distinct_in_order(F.flatten(F.transform("steps", lambda s: F.coalesce(s["selected_skills"], F.array().cast("array<string>")))))
    named = failed.withColumn("wrong_skills", skills)
    return named.withColumn("error_tag", routing.failure_tag(F.col("question"), F.col("prediction"), F.col("wrong_skills"))).withColumn("id", F.concat(F.lit(f"{dataset}_failure_"), F.col("id").cast("string")))


def runtime_failure(rows: DataFrame, kind: Column, message: Column) -> DataFrame:
    """M5: a record for rows whose rollout broke off."""
    return rows.withColumn("validation", F.struct(F.lit(False).alias("passed"), F.lit(True).alias("runtime_error"), kind.alias("error_type"), message.alias("error_message")))


def merge_shards(traces: DataFrame) -> DataFrame:
    """Shards (shard, idx, ...) as one ordered table; shard names sort as text."""
    return traces.orderBy(F.col("shard").cast("string"), "idx")
