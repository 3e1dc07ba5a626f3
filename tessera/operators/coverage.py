"""Coverage sampling (survey P13, P14, A5, W7-W10, W14, J4, J5, J11, J12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import written

from .sampling import SHORT_HEAD, first_of_groups, head, seeded

#: Rounds of ``refill`` that one job settles.
ROUNDS_PER_JOB = 3


def groups(profiles: DataFrame, key: str = "signature", representatives: DataFrame | None = None) -> DataFrame:
    """One row per signature with its size, ids by md5, its attributes by its row of the smallest id.

    ``representatives`` (key, answer_form_hint, place): the answer form is that of the first one, else of the smallest id.
    """
    own = {"native_type": "native_type", "hop_count": "hop_count", "flags": "heuristic_flags", "entity_bin": "entity_bin", "answer_form_hint": "answer_form"}
    made = profiles.groupBy("dataset", key).agg(F.count(F.lit(1)).alias("size"), *[F.min_by(c, "id").alias(n) for c, n in own.items()])
    if representatives is not None:
        first = representatives.groupBy(F.col(key).alias("__key")).agg(F.min_by("answer_form_hint", "place").alias("__form"))
        made = made.join(first, F.col(key) == F.col("__key"), "left").withColumn("answer_form", F.coalesce("__form", "answer_form")).drop("__key", "__form")
    return made.withColumn("group_id", tx.short_md5(F.col(key)))


def annotate(group: DataFrame) -> DataFrame:
    """Rule-based annotation of groups (size, native_type, hop_count, heuristic_flags, entity_bin)."""
    f, n = F.col("heuristic_flags"), F.coalesce("native_type", F.lit("unknown"))

    def flag(*names: str) -> Column:
        return F.arrays_overlap(f, F.array(*[F.lit(x) for x in names]))

    compare = flag("comparison") | F.contains(n, F.lit("comparison"))
    chain = flag("relation_chain") | F.contains(n, F.lit("bridge")) | F.contains(n, F.lit("inference")) | (F.col("hop_count") >= 3)
    time, many, same = flag("temporal", "time_anchor"), flag("multi_entity") | F.col("entity_bin").isin("multi_entity", "dense_entity"), flag("same_attribute")
    check, count = flag("yes_no", "verification"), flag("numeric")
    always = F.lit(True)
    # The names of reasoning types, skill demands and entity patterns.
    reasoning = tx.choices((always, "compositional_lookup"), (compare, "comparison_reasoning"), (chain, "relation_chain"), (chain, "bridge_reasoning"), (time, "temporal_reasoning"), (count, "numerical_reasoning"), (check, "verification_or_yes_no"), (many, "multi_entity_grounding"), (same, "set_constraint"))
    demands = tx.choices((always, "answer_composition"), (compare, "comparison"), (chain, "relation_following"), (chain, "bridge_search"), (time, "temporal_filtering"), (count, "aggregation_or_counting"), (check, "evidence_verification"), (many, "entity_grounding"), (same, "constraint_filtering"))
    pattern = F.when(same, "set_constraint").when(many, "multi_entity").when(chain, "relation_chain").when(compare, "pairwise_entities").otherwise("single_entity")
    out = group.withColumn("reasoning_types", F.array_sort(reasoning)).withColumn("skill_demands", F.array_sort(demands)).withColumn("entity_pattern", pattern)
    high = (F.col("size") < 32) | F.col("entity_pattern").isin("multi_entity", "relation_chain", "set_constraint")
    return out.withColumn("coverage_priority", F.when(F.col("hop_count") >= 4, 5).when(high, 4).otherwise(3)).withColumn("difficulty", F.when(F.col("hop_count") >= 4, "hard").otherwise("medium"))


def with_answers(heuristic: DataFrame, answers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Given answers override the heuristic's columns."""
    named = answers.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = heuristic.join(named, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop("__key", *[f"__{c}" for c in columns])


def reviewed(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Rows without a review pass, rows whose review says no are dropped."""
    named = reviews.select(F.col(key).alias("__key"), F.col("keep").alias("__keep"))
    return rows.join(named, F.col(key) == F.col("__key"), "left").where(F.coalesce("__keep", F.lit(True))).drop("__key", "__keep")


def group_priority(annotated: DataFrame, labels: str = "labels") -> DataFrame:
    """2.5 * priority + the labels' rarity 1 / sqrt(weighted frequency) + 0.15 * log2(size + 1)."""
    each = annotated.select("group_id", "size", F.explode(labels).alias("label"))
    freq = each.groupBy("label").agg(F.sum("size").alias("freq"))
    rarity = each.join(freq, "label").groupBy("group_id").agg(F.sum(1.0 / F.sqrt("freq")).alias("rarity"))
    scored = annotated.join(rarity, "group_id", "left")
    return scored.withColumn("priority", F.round(2.5 * F.col("coverage_priority") + F.coalesce("rarity", F.lit(0.0)) + 0.15 * F.log2(F.col("size") + 1), 9))


def quota_plan(table: list[dict], target: int) -> dict[str, int]:
    """Rows to take of each group. ``table``: group_id, size, priority, labels of every group.

    Labels go by ascending (frequency, label). Each label with less than its quota takes rows from groups in order of
    priority; every taken row counts for all labels of its group. What is left of the target goes round robin (W10).
    The table has a row per signature group, thousands at most, as its key is a tuple of small categories.
    """
    freq: dict[str, int] = {}
    for g in table:
        for label in g["labels"]:
            freq[label] = freq.get(label, 0) + g["size"]
    ranked = sorted(table, key=lambda g: (-g["priority"], g["group_id"]))
    left, taken, count, total = {g["group_id"]: g["size"] for g in table}, {g["group_id"]: 0 for g in table}, dict.fromkeys(freq, 0), 0
    quota = max(24, min(80, target // 100))
    for label in sorted(freq, key=lambda x: (freq[x], x)):
        for g in ranked:
            need = min(quota - count[label], target - total)
            if need <= 0:
                break
            if label in g["labels"]:
                k = min(need, left[g["group_id"]])
                left[g["group_id"]] -= k
                taken[g["group_id"]] += k
                total += k
                for own in g["labels"]:
                    count[own] += k
    rest = target - total
    open_ = [g["group_id"] for g in ranked if left[g["group_id"]]]
    while rest > 0 and open_:
        each = max(1, min(rest // len(open_), min(left[g] for g in open_)))
        for g in open_:
            k = min(each, rest)
            left[g] -= k
            taken[g] += k
            rest -= k
        open_ = [g for g in open_ if left[g]]
    return {g: n for g, n in taken.items() if n}


def coverage_sample(rows: DataFrame, table: DataFrame, target: int, key: str = "id", seed: int = 20260327) -> DataFrame:
    """Rows drawn by ``quota_plan``, inside a group in seeded random order."""
    plan = quota_plan([r.asDict() for r in table.select("group_id", "size", "priority", "labels").collect()], target)
    wanted = rows.sparkSession.createDataFrame(list(plan.items()), "planned_group string, take int")
    # A row per group: the plan goes to all tasks, as the group table went to the driver.
    near = rows.join(F.broadcast(wanted), F.col("group_id") == F.col("planned_group"))
    ranked = first_of_groups(near, ["group_id"], [seeded(seed, F.col(key)), F.col(key)], max(plan.values(), default=0))
    return ranked.where(F.col("__rank") <= F.col("take")).drop("__rank", "planned_group", "take")


def refill(candidates: DataFrame, selected: DataFrame, rejected: DataFrame, question: Column, n: int, order_in_group: Column, group_rank: Column, key: str = "id", severe: Column | None = None) -> DataFrame:
    """N further rows, one per group and turn, whose question is neither taken nor rejected nor severely suspicious.

    Groups take turns in order of ``group_rank``; at its turn a group takes its first row, by ``order_in_group``, whose
    question nobody has taken before. ``selected`` and ``rejected`` have the column ``question_key``.

    A row's turn is its place in the group less the rows before it whose question others took. No group has more than n
    turns, and at most n questions are taken, so rows beyond a group's first 2 n are not needed; the rest is few. Only
    questions that stand in several groups are open; round by round those are settled that no row with a possibly earlier
    turn can take.
    """
    named = candidates.withColumn("question_key", question).join(selected.select(key), key, "left_anti")
    named = named if severe is None else named.where(~F.coalesce(severe, F.lit(False)))
    fresh = named.join(selected.select("question_key").union(rejected.select("question_key")).distinct(), "question_key", "left_anti")
    inside = fresh.select(key, "group_id", "question_key", order_in_group.alias("__order"), group_rank.alias("__rank_of"))
    # A question that comes again in its group is never free when its turn comes.
    again = F.row_number().over(Window.partitionBy("group_id", "question_key").orderBy("__order", key))
    own = inside.withColumn("__again", again).where("__again = 1").drop("__again")
    near = first_of_groups(own, ["group_id"], [F.col("__order"), F.col(key)], 2 * n).withColumnRenamed("__rank", "__place").drop("__order")
    shared = F.count(F.lit(1)).over(Window.partitionBy("question_key"))
    placed_ = written(near.withColumn("__open", shared > 1))
    open_ = placed_.where("__open").select(F.col(key).alias("row"), "group_id", "question_key", F.col("__rank_of").alias("rank"), F.col("__place").alias("place"), F.lit(None).cast("boolean").alias("won"))
    # Windows by group see at most 2 n rows of it.
    before = Window.partitionBy("group_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    of_question = Window.partitionBy("question_key")

    def settled(rows: DataFrame) -> DataFrame:
        lost = F.coalesce(F.count_if(F.col("won") == F.lit(False)).over(before), F.lit(0))
        unsure = F.coalesce(F.count_if(F.col("won").isNull()).over(before), F.lit(0))
        known = rows.withColumn("late", F.col("place") - lost).withColumn("early", F.col("late") - unsure)
        undecided, taken = F.col("won").isNull(), F.max("won").over(of_question)
        first = F.min(F.when(undecided, F.struct("early", "rank", "row"))).over(of_question)
        sure = (F.col("late") == F.col("early")) & (F.struct("early", "rank", "row") == first)
        # A certain turn wins if it is the earliest that any row of the question may have.
        step = known.withColumn("win", undecided & sure).withColumn("any", F.max("win").over(of_question) | F.coalesce(taken, F.lit(False)))
        won = F.when(~undecided, F.col("won")).when(F.col("win"), True).when(F.col("any"), False)
        return step.select("row", "group_id", "question_key", "rank", "place", won.alias("won"))

    while open_.where("won IS NULL").limit(1).count():
        # Several rounds a job.
        for _ in range(ROUNDS_PER_JOB):
            open_ = settled(open_)
        open_ = written(open_)
    gone = open_.where("NOT won").select(F.col("row").alias(key))
    turned = placed_.join(gone, key, "left_anti").withColumn("__turn", F.row_number().over(Window.partitionBy("group_id").orderBy("__place")))
    picked = head(turned, n, ["__turn", "__rank_of", key]).select(F.col(key).alias("__picked"), "__turn", F.col("__rank_of"))
    # The picked rows are n at most.
    return candidates.join(F.broadcast(picked) if n <= SHORT_HEAD else picked, F.col(key) == F.col("__picked")).orderBy("__turn", "__rank_of", key).drop("__picked", "__turn", "__rank_of")


def budget_pick(group: DataFrame, most: int, top: int = 8, top_flag: int = 10) -> DataFrame:
    """At most ``most`` annotated groups for a costly review, in stages.

    First the largest of each native type, hop count and entity bin, then of each of the flags that matter, then the
    rest by ten times their priority plus log2 of their size. ``stage`` tells by which they came in.
    """
    # The flags whose groups are taken on their own.
    flags = ("multi_entity", "relation_chain", "same_attribute", "yes_no", "temporal", "numeric", "dense_entities", "comparison")
    largest = [F.col("size").desc(), F.col("group_id")]

    def rank(by: Column | str) -> Column:
        return F.row_number().over(Window.partitionBy(by).orderBy(*largest))

    stages = [F.when(rank(c) <= top, k) for k, c in enumerate(("native_type", "hop_count", "entity_bin"))]
    for k, flag in enumerate(flags, len(stages)):
        held = F.array_contains("heuristic_flags", flag)
        stages.append(F.when(held & (rank(held) <= top_flag), k))
    last = F.lit(len(stages))
    staged = group.withColumn("stage", F.least(*stages, last))
    rest = F.col("coverage_priority") * 10 + F.log2(F.col("size") + 1)
    # Buckets come in order of their largest group within a stage, the rest by its own score.
    lead = F.struct((-F.col("size")).alias("size"), "group_id")
    leads = [F.min(lead).over(Window.partitionBy(c)) for c in ("native_type", "hop_count", "entity_bin")]
    bucket = F.when(F.col("stage") == 0, leads[0]).when(F.col("stage") == 1, leads[1]).when(F.col("stage") == 2, leads[2])
    ordered = staged.withColumn("__bucket", bucket).withColumn("__score", F.when(F.col("stage") == last, rest).otherwise(F.col("size").cast("double")))
    kept = ordered if most <= 0 else head(ordered, most, ["stage", "__bucket", F.col("__score").desc(), "group_id"])
    return kept.drop("__bucket", "__score")


def materialise_selected(full: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    """The full records of the selected keys, by a semi join; order them at the sink."""
    return full.join(selected.select(key), key, "left_semi")
