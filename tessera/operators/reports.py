"""Reports and evaluation metrics (survey A1-A22, W23, M7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

from .sampling import segmented


def distributions(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A1: counts of each column's values in one pass: (dimension, value, count, share)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("dimension")), 9))


def exploded_counts(rows: DataFrame, values: str, n: int | None = None) -> DataFrame:
    """A2: counts of array elements, the n most frequent if asked for."""
    out = rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return out if n is None else out.orderBy(F.desc("count"), "value").limit(n)


def ratio(part: Column, whole: Column) -> Column:
    """Part over at least 1."""
    return part / F.greatest(whole, F.lit(1))


def outcome_counts(rows: DataFrame, by: str) -> DataFrame:
    """Processed, passed, failed and runtime errors of each group."""
    good = F.coalesce(F.col("passed"), F.lit(False))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("processed"), F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"), F.count_if(F.coalesce(F.col("runtime_error"), F.lit(False))).alias("runtime_errors"))


def step_measures(steps: Column) -> dict[str, Column]:
    """Searches, steps, distinct skills and tagged turns of a trace; steps have action, selected_skills and generated.

    A search counts as tagged if its text holds a search tag, the final turn if the last step's holds an answer tag.
    """
    search = F.filter(steps, lambda s: s["action"] == "search")
    tagged = F.filter(search, lambda s: F.contains(F.lower(F.coalesce(s["generated"], F.lit(""))), F.lit("<search>")))
    skills = F.array_distinct(F.flatten(F.transform(steps, lambda s: F.coalesce(s["selected_skills"], F.array().cast("array<string>")))))
    final = F.coalesce(F.contains(F.lower(F.try_element_at(steps, F.lit(-1))["generated"]), F.lit("<answer>")), F.lit(False))
    return {"search_steps": F.size(search), "total_steps": F.size(steps), "n_skills": F.size(skills), "tagged_search": F.size(tagged), "tagged_final": final.cast("int")}


def eval_metrics(traces: DataFrame, by: str) -> DataFrame:
    """Exact match and search behaviour of each group of traces (em, steps)."""
    m = traces.withColumns(step_measures(F.col("steps")))
    n = F.count(F.lit(1))
    return m.groupBy(by).agg(
        n.alias("n_examples"), F.sum("em").cast("bigint").alias("n_correct"), ratio(F.sum("em"), n).alias("em"), F.avg("search_steps").alias("avg_search_steps"), F.avg("total_steps").alias("avg_total_steps"),
        F.avg("n_skills").alias("avg_skills"), F.avg("tagged_final").alias("tagged_final_turn_rate"), ratio(F.sum("tagged_search"), F.sum("search_steps")).alias("tagged_search_turn_rate"),
        ratio(F.count_if((F.col("em") == 1) & (F.col("search_steps") <= 3)), n).alias("correct_within_3"),
    )


def running_em(traces: DataFrame, by: str, order: str) -> DataFrame:
    """A10: share of correct answers so far; data sets are few and of any size, so sums come from a sort by ranges."""
    along = segmented(traces, [by], [order], {"__correct": F.col("em")})
    return along.withColumn("running_em", F.col("__correct") / F.col("__rank")).drop("__correct", "__rank", "__n")


def macro_average(metrics: DataFrame, value: str = "em") -> DataFrame:
    """Unweighted mean over groups."""
    return metrics.agg(F.avg(value).alias(f"macro_{value}"))


def pooled(metrics: DataFrame) -> DataFrame:
    """Correct over all examples of all shards."""
    return metrics.agg(F.sum("n_correct").alias("n_correct"), F.sum("n_examples").alias("n_examples"), ratio(F.sum("n_correct"), F.sum("n_examples")).alias("em"))


def macro_and_pooled(metrics: DataFrame) -> DataFrame:
    """A18 and A19 in one aggregation."""
    return metrics.agg(F.avg("em").alias("macro_em"), F.sum("n_correct").alias("n_correct"), F.sum("n_examples").alias("n_examples"), ratio(F.sum("n_correct"), F.sum("n_examples")).alias("pooled_em"))


def flips(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Newly right and newly wrong answers between two runs."""
    both = before.select(key, F.col("em").alias("old")).join(after.select(key, F.col("em").alias("new")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("old") == 0) & (F.col("new") == 1)).alias("newly_correct"), F.count_if((F.col("old") == 1) & (F.col("new") == 0)).alias("newly_wrong"))


def reward(em: Column, gold: Column, retrieved: Column, queries: Column, evidence: float, duplicate: float) -> Column:
    """Em + evidence weight if a gold answer was retrieved - duplicate weight for each repeated query."""
    seen = F.exists(gold, lambda g: F.exists(retrieved, lambda r: F.contains(F.lower(r), F.lower(g))))
    return em + F.lit(evidence) * seen.cast("int") - F.lit(duplicate) * (F.size(queries) - F.size(F.array_distinct(queries)))


def histogram(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A15, A16."""
    return rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def rounded_mean(value: Column) -> Column:
    """Mean to two digits, half to even."""
    return F.bround(F.avg(value), 2)


def query_copy(question: Column, query: Column) -> Column:
    """Token Jaccard of a question and the first query, our own definition of copying."""
    a, b = (F.array_distinct(F.split(tx.normalize_answer_eval(x), " ")) for x in (question, query))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
