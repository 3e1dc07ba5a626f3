"""Ranking, sampling and deduplication (survey W1-W16, W20-W23, W25, J10, A4) on DataFrames.

Orders are total: each ends with the key, so results do not depend on how rows are dealt out. Random picks order by the
md5 of seed and key instead of a generator's state. Windows are partitioned by group keys of many values; ranks over all
rows or over groups of few values come from a range-partitioned sort and the numbers of rows of its partitions, so that
no task gets more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

#: Heads up to this many rows are kept per partition and merged; longer ones are cut from a sorted table.
SHORT_HEAD = 10_000
#: Distinct labels that are looked up in a map; with more, rows are joined with their table.
MAP_LABELS = 10_000


#: Up to this rank Spark limits the groups of a window before it shuffles them (its own default threshold).
GROUP_LIMIT = 1000


def placed(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with ``__i``, their place from 0 in a total order; a written table, sorted by ranges.

    A window without partitions would put all rows into one task, so places come from the rows' numbers within their
    partitions and the sums of the partitions before, a table with one row per partition. It is written first: sampled
    ranges must not be computed anew for a lost task.
    """
    ordered = written(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__m", 33)
    counts = ordered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    found = ordered.join(before, part == F.col("__p"))
    return found.withColumn("__i", F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).select(*rows.columns, "__i")


def segmented(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``__rank`` (from 1) within the groups ``by``, ``__n``, the group's rows, and running sums, by ``order``.

    For groups of few values, which may hold any share of all rows: a window over them would put a group into one task.
    Rows are sorted by ranges of group and order instead, and written; a run is a range's part of a group, and what the
    runs before it hold is added to places and sums within it. The table of runs has a row per range and group.
    """
    sums = sums or {}
    held = rows.withColumns({f"__v{k}": value for k, value in enumerate(sums.values())})
    ordered = written(held.orderBy(*[F.asc_nulls_first(c) for c in by], *order).withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33)), "segmented")
    runs = ordered.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__first"), *[F.sum(f"__v{k}").alias(f"__s{k}") for k in range(len(sums))])
    group = Window.partitionBy(*by)
    before = group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    told = runs.withColumns({"__n": F.sum("__c").over(group), "__before": F.coalesce(F.sum("__c").over(before), zero), **{f"__b{k}": F.coalesce(F.sum(f"__s{k}").over(before), zero) for k in range(len(sums))}})
    told = told.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__g{k}") for k, c in enumerate(by)], "__first", "__n", "__before", *[f"__b{k}" for k in range(len(sums))])
    same = F.col("__p") == F.col("__q")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    # Runs are no larger than a range, so neither this join nor the sums within runs have hot keys.
    found = ordered.join(told, same)
    inside = Window.partitionBy("__p", *by).orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    out = [F.sum(f"__v{k}").over(inside) + F.col(f"__b{k}") for k in range(len(sums))]
    return found.select(*rows.columns, (F.col("__m") - F.col("__first") + F.col("__before") + 1).alias("__rank"), "__n", *[c.alias(name) for c, name in zip(out, sums, strict=True)])


def first_of_groups(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with ``__rank``.

    Up to GROUP_LIMIT the window keeps n rows of each group in every task before it shuffles, whatever a group's size;
    beyond, places come from a sort by ranges.
    """
    if n < GROUP_LIMIT:
        return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n)
    return segmented(rows, by, order).where(F.col("__rank") <= n).drop("__n")


def head(rows: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows of a total order."""
    if n <= SHORT_HEAD:
        return rows.orderBy(*order).limit(n)
    return placed(rows, order).where(F.col("__i") < n).drop("__i")


def seeded(seed: int | str, *keys: Column) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary"))


def label_counts(rows: DataFrame, labels: str = "labels", weight: Column | None = None) -> DataFrame:
    """A5: (label, freq), each row counted or weighted."""
    return rows.select(F.explode(labels).alias("label"), (F.lit(1) if weight is None else weight).alias("w")).groupBy("label").agg(F.sum("w").cast("bigint").alias("freq"))


def label_rarity(rows: DataFrame, key: str, labels: str = "labels") -> DataFrame:
    """Rows with ``rarity``, the sum of 1 / count over their labels, and ``rarest``, the smallest count.

    Labels name categories, tens of them: their counts are a map in the plan and rows are not shuffled. Beyond
    MAP_LABELS, rows are joined with the label table.
    """
    counts = label_counts(rows, labels)
    few = counts.limit(MAP_LABELS + 1).collect()
    if len(few) <= MAP_LABELS:
        ordered = sorted((r.label, r.freq) for r in few)
        freq = F.map_from_arrays(F.array(*[F.lit(x) for x, _ in ordered]).cast("array<string>"), F.array(*[F.lit(n) for _, n in ordered]).cast("array<bigint>"))
        each = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.try_element_at(freq, x))
        total = F.aggregate(each, F.lit(0.0), lambda a, n: a + F.lit(1.0) / n)
        return rows.withColumn("rarity", F.round(total, 9)).withColumn("rarest", F.array_min(each))
    each = rows.select(F.col(key).alias("__key"), F.explode(labels).alias("label"))
    scored = each.join(counts, "label").groupBy("__key").agg(F.round(F.sum(F.lit(1.0) / F.col("freq")), 9).alias("rarity"), F.min("freq").alias("rarest"))
    return rows.join(scored, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("rarity", F.coalesce("rarity", F.lit(0.0)))


def protect_rare(rows: DataFrame, group: str, threshold: Column | int, most: int = 3) -> DataFrame:
    """``group_size``, and ``protected`` where the group or one of the row's labels is rare."""
    sizes = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("group_size"))
    sized = rows.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    small, rare = F.col("group_size") <= most, F.coalesce(F.col("rarest") <= threshold, F.lit(False))
    return sized.withColumn("protect_reason", F.when(small & rare, "both").when(small, "rare_signature").when(rare, "rare_label")).withColumn("protected", small | rare)


def cap_per_group(rows: DataFrame, group: str, cap: int, order: Sequence[Column]) -> DataFrame:
    """Keep protected rows and fill each group up to max(cap, protected) by rank."""
    first = Window.partitionBy(group).orderBy(F.col("protected").desc(), *order)
    # Protected rows come first, so the rank limit keeps them all without a second pass.
    kept = rows.withColumn("rank", F.row_number().over(first))
    return kept.where(F.col("protected") | (F.col("rank") <= cap)).drop("rank")


def fill_to(selected: DataFrame, pool: DataFrame, key: str, target: int, order: Sequence[Column]) -> DataFrame:
    """Append the best rows of the pool that are not selected until ``target`` rows."""
    short = max(0, target - selected.count())
    if not short:
        return selected
    rest = pool.join(selected.select(key), key, "left_anti").select(selected.columns)
    return selected.unionByName(head(rest, short, order))


def best(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of an order."""
    return head(rows, n, order)


def representatives(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows at k evenly spaced ranks of each group, ranks rounded half to even."""
    ranked = segmented(rows, group, order)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(max(k - 1, 1)))).cast("bigint"))
    return ranked.where((F.col("__n") <= k) | F.array_contains(places, F.col("__rank") - 1)).drop("__rank", "__n")


def stratified_top(strata: Sequence[tuple[DataFrame, Sequence[str], int]], key: str, order: Sequence[Column]) -> DataFrame:
    """The top rows of each stratum's groups; a row keeps the first stage that picked it."""
    picked = None
    for stage, (rows, by, n) in enumerate(strata):
        top = first_of_groups(rows, by, order, n).select(*rows.columns, F.lit(stage).alias("stage"))
        picked = top if picked is None else picked.unionByName(top)
    first = Window.partitionBy(key).orderBy("stage")
    return picked.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """One row of each group in turn, in random order of groups and rows, until n rows.

    Before a row of turn t come t - 1 rows of its own group, so only the first n rows of a group can be among them.
    """
    turn = first_of_groups(rows, [group], [seeded(seed, F.col(key)), F.col(key)], n).withColumnRenamed("__rank", "turn")
    return head(turn, n, ["turn", seeded(seed, F.col(group)), F.col(group), F.col(key)])


def dedup_first(rows: DataFrame, by: Column, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = rows.withColumn("__by", by)
    return ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("__by").orderBy(*order))).where("__rank = 1").drop("__by", "__rank")


def dedup_conflicts(rows: DataFrame, question: Column, answer: Column, order: Sequence[Column], key: str | None = None) -> DataFrame:
    """Rows with ``status``: kept, duplicate, or conflicting where a question has several answers.

    ``key``: only the first row of each key takes part, further ones are ``duplicate_id``.
    """
    named = rows.withColumn("__q", question).withColumn("__a", answer).withColumn("__again", F.lit(False))
    if key is not None:
        named = named.withColumn("__again", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)
    of_question = Window.partitionBy("__q", "__again")
    differ = F.min("__a").over(of_question) != F.max("__a").over(of_question)
    first = F.row_number().over(of_question.orderBy(*order))
    told = named.withColumn("__differ", F.coalesce(differ, F.lit(False))).withColumn("__rank", first)
    status = F.when(F.col("__again"), "duplicate_id").when(F.col("__differ"), "conflicting").when(F.col("__rank") > 1, "duplicate").otherwise("kept")
    return told.withColumn("status", status).drop("__q", "__a", "__again", "__differ", "__rank")


def drop_counts(rows: DataFrame) -> DataFrame:
    """How many rows ``status`` drops for which reason, in one row."""
    reasons = {"dropped_duplicate_id": "duplicate_id", "dropped_duplicate_question": "duplicate", "dropped_conflicting_question": "conflicting", "dropped_quality": "quality"}
    return rows.agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in reasons.items()])


def first_distinct(rows: DataFrame, group: Sequence[str], value: Column, order: Sequence[Column], n: int) -> DataFrame:
    """Per group the first n rows with distinct, non-blank values."""
    named = rows.withColumn("__v", value).where(F.trim(F.col("__v")) != "")
    once = named.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__v").orderBy(*order))).where("__rank = 1")
    return once.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= n).drop("__v", "__rank")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The latest row of each key, by partial aggregation instead of a sort."""
    kept = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("__row"))
    return latest.select(*keys, *[F.col("__row")[c].alias(c) for c in kept])


def oversample(rows: DataFrame, times: Column, key: str) -> DataFrame:
    """Each row ``times`` times; ids of further copies end in ``__rep{k}``."""
    out = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    name = F.when(F.col("rep") == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("__rep"), F.col("rep").cast("string")))
    return out.withColumn("copy_id", name)


def contiguous_shards(rows: DataFrame, order: Sequence[Column], shards: int) -> DataFrame:
    """Shards of consecutive rows, the first ones a row longer."""
    found = placed(rows, order)
    n = found.count()
    base, rest = divmod(n, shards)
    at, edge = F.col("__i"), rest * (base + 1)
    shard = F.when(at < edge, F.floor(at / F.lit(base + 1))).otherwise(rest + F.floor((at - edge) / F.lit(max(base, 1))))
    return found.withColumn("shard", shard.cast("int")).drop("__i")


def split_quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """How many rows of each group go to the evaluation side; groups in alphabetical order."""
    left, rows, out = total, sum(sizes.values()), {}
    for name in sorted(sizes):
        n = sizes[name]
        out[name] = min(max(1, round(n * left / rows)), n, left) if left > 0 and rows else 0
        left, rows = left - out[name], rows - n
    return out


def train_eval_split(rows: DataFrame, group: str, key: str, n_eval: int, seed: int = 42) -> DataFrame:
    """Rows with ``part`` train or eval; groups are few, their sizes decide the quotas on the driver.

    A group's evaluation rows are the first of its seeded order. Only rows whose digest begins under a bound can be
    among them; the bound is raised until enough are, and no more than those are ranked.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().collect() if r[0] is not None}
    quotas = {g: q for g, q in split_quotas(sizes, n_eval).items() if q}
    digest = seeded(seed, F.col(key))
    begin = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    narrow = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), digest.alias("digest"), begin.alias("u"))
    bounds = {g: min(1.0, 1.5 * (q + 10) / sizes[g]) for g, q in quotas.items()}

    def per_group(values: dict, other: float) -> Column:
        out = F.lit(other)
        for g, x in values.items():
            out = F.when(F.col("g") == g, x).otherwise(out)
        return out

    while True:
        near = narrow.where(F.col("u") <= per_group(bounds, -1.0))
        held = {r.g: r.n for r in near.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [g for g, q in quotas.items() if held.get(g, 0) < q]
        if not short:
            break
        bounds |= {g: min(1.0, 4 * bounds[g]) for g in short}
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("digest", "k")))
    chosen = ranked.where(F.col("rank") <= per_group(quotas, 0)).select(F.col("k").alias("__chosen"))
    return rows.join(chosen, F.col(key) == F.col("__chosen"), "left").withColumn("part", F.when(F.col("__chosen").isNotNull(), "eval").otherwise("train")).drop("__chosen")
