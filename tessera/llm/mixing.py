"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies r = target / source size. Documents are put
in an order, the expected copies are summed along it from one random offset, and a document is emitted once for each
integer boundary that its step crosses. Any stretch of that order then holds its expected copies to within one.

The order runs through size classes, so that long and short documents each get their share and the words taken stay
close to the target. A class is cut into buckets of about ``BUCKET`` rows by a hash of the document, the bucket counts
are summed up in a table of rows / BUCKET entries, and only rows inside one bucket are ever ranked together: no
source, however large, meets in a single task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources without words have
target 0 and nothing is taken; repeated rows are documents of their own; an empty table gives an empty result; the
result has the input's columns plus COLUMNS, replacing input columns with these names. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

#: Rows that are ranked together.
BUCKET = 4096
#: A source gives at most this many times its size.
CAP = 3
COLUMNS = ("size", "source_size", "target", "copies")
_P = "__mix_"


def size_class(size: Column) -> Column:
    """Eight classes per doubling of the size."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).cast("int")).cast("int")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size) -> with target: shares by weight, capped, the excess shared out again.

    Weights follow ``cycle`` by code point order of the source, null last. With sources in ascending order of
    cap / weight the capped ones are a prefix of that order, and the water level is the largest of the levels that
    assume the first k sources capped. One row per source, so one window over all of them is small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * cap)
    whole = Window.partitionBy()
    before = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    return (
        weighed.withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight").cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def _hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def plan(rows: DataFrame, seed: int = 42, cycle: tuple[int, ...] = (1, 2, 3), cap: int = CAP, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (id, source, size and ``ties``), a written frame -> the same rows with source_size, target and copies.

    Rows are ranked here, so they should be narrow: nothing else is shuffled. ``ties`` order rows of an equal id.
    """
    digest, cls = _hash(seed, F.col("id")), size_class(F.col("size"))
    classes = rows.groupBy("source", cls.alias(f"{_P}class")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    buckets = classes.select("source", f"{_P}class", F.ceil(F.col("n") / BUCKET).cast("bigint").alias(f"{_P}buckets"))
    shares = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, cap)

    # The bucket of each row; the class table has sources x size classes rows.
    keyed = rows.withColumn(f"{_P}class", cls).withColumn(f"{_P}digest", digest).withColumnRenamed("source", f"{_P}source")
    found = keyed.join(buckets, F.col(f"{_P}source").eqNullSafe(F.col("source")) & (keyed[f"{_P}class"] == buckets[f"{_P}class"])).drop("source").drop(buckets[f"{_P}class"])
    bucketed = found.withColumn(f"{_P}bucket", _number(F.col(f"{_P}digest")) % F.col(f"{_P}buckets"))

    group = [f"{_P}source", f"{_P}class", f"{_P}bucket"]
    counted = bucketed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(f"{_P}source").orderBy(f"{_P}class", f"{_P}bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*group, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias(f"{_P}before"))
    offsets = offsets.join(shares, F.col(f"{_P}source").eqNullSafe(F.col("source"))).select(
        *[F.col(g).alias(f"{g}_o") for g in group], f"{_P}before", "source_size", "target"
    )

    ranked = bucketed.withColumn(f"{_P}rank", F.row_number().over(Window.partitionBy(*group).orderBy(f"{_P}digest", "id", *ties)).cast("bigint"))
    placed = ranked.join(
        offsets,
        F.col(f"{_P}source").eqNullSafe(F.col(f"{_P}source_o")) & (F.col(f"{_P}class") == F.col(f"{_P}class_o")) & (F.col(f"{_P}bucket") == F.col(f"{_P}bucket_o")),
    )
    # The offset has 20 bits, so sums with whole numbers of copies stay exact.
    offset = (_number(_hash(seed + 1, F.col(f"{_P}source"))) % (1 << 20)).cast("double") / float(1 << 20)
    each = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    rank = F.col(f"{_P}before") + F.col(f"{_P}rank")
    copies = F.floor(offset + each * rank.cast("double")) - F.floor(offset + each * (rank - 1).cast("double"))
    return placed.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("bigint")).withColumnRenamed(f"{_P}source", "source").select(
        "id", "source", "size", *ties, "source_size", "target", "copies"
    )


def _placed(docs: DataFrame, kept: list[str], seed: int, cycle: tuple[int, ...], cap: int, id_col: str, taken_only: bool) -> DataFrame:
    """row (a struct of the columns ``kept``), size, source_size, target and copies of each row.

    Ranks are taken of narrow rows (id, hash of the text, source, size). Whole rows are shuffled once, by a key of id,
    text and source, to meet their copies. Documents of a source have one of two numbers of copies, so rows that repeat
    id, text and source need no more than those two and how often each stands.
    """
    own = [F.col(f"`{id_col}`"), F.col("text"), F.col("source")]
    marked = [*own, *[c.isNull() for c in own]]
    key, check = F.xxhash64(*marked).alias("key"), F.xxhash64(F.lit(1), *marked).alias("check")
    narrow = docs.select(own[0].alias("id"), own[2].alias("source"), n_words(own[1]).alias("size"), key, check)
    planned = materialise(plan(materialise(narrow, "mix-sizes"), seed, cycle, cap, ("key", "check")), "mix-plan")
    most = planned.groupBy("key", "check").agg(
        F.max("copies").alias("high"), F.min("copies").alias("low"), F.count(F.lit(1)).alias("all"), F.sum("copies").alias("sum"),
        *[F.first(c).alias(c) for c in ("size", "source_size", "target")],
    )
    most = most.where("high > 0") if taken_only else most
    # Each task hashes its part of the numbers, a few bytes for each text that it meets; texts are not sorted.
    most = most.withColumnsRenamed({"key": "key_", "check": "check_"}).hint("shuffle_hash")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), key, check)
    met = wide.join(most, (F.col("key") == F.col("key_")) & (F.col("check") == F.col("check_")))
    even = met.where("high = low").select("row", *COLUMNS[:-1], F.col("high").alias("copies"))
    # Repeated rows of unequal numbers: high * n + low * (all - n) = sum gives how many have the greater one.
    turn = F.row_number().over(Window.partitionBy("key", "check").orderBy(F.lit(0)))
    odd = met.where("high > low").withColumn("turn", turn).withColumn("often", F.expr("(sum - low * all) div (high - low)"))
    copies = F.when(F.col("turn") <= F.col("often"), F.col("high")).otherwise(F.col("low"))
    return even.unionByName(odd.select("row", *COLUMNS[:-1], copies.alias("copies")))


def mix(docs: DataFrame, seed: int = 42, cycle: tuple[int, ...] = (1, 2, 3), cap: int = CAP, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (id, text, source, ...) -> the same rows with size, source_size, target and copies."""
    kept = [c for c in docs.columns if c.lower() not in COLUMNS]
    return _placed(docs, kept, seed, cycle, cap, id_col, False).select(*[F.col("row").getField(c).alias(c) for c in kept], *COLUMNS)


def take(docs: DataFrame, seed: int = 42, cycle: tuple[int, ...] = (1, 2, 3), cap: int = CAP, id_col: str = "doc_id") -> DataFrame:
    """One row per copy that the mix takes, with the columns of ``docs``, whatever their names."""
    placed = _placed(docs, docs.columns, seed, cycle, cap, id_col, True).where("copies > 0")
    copies = placed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
