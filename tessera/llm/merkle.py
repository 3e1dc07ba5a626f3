"""Merkle manifest of a dataset: leaves, subroots, root and a proof for every document.

H is the lower-case hex SHA-256 of its inputs, concatenated; digests are inputs as hex text. A leaf is H of the fields
doc_id, source, lang, n_chars, text, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Per source,
leaves ascend by doc_id; while several nodes remain, each run of FAN consecutive ones becomes its H. What remains is the
source's subroot, and subroots, by source, give the root likewise.

Leaves are cut into buckets of FAN ** BUCKET_LEVELS consecutive leaves of a source, whole subtrees by construction, so a
source of any size is spread evenly. In the tasks DuckDB runs the levels of the buckets, a query of ordered string_agg
and sha256 for each level, on Arrow blocks that hold whole buckets. Spark combines the buckets' roots level by level and
joins what is needed above a bucket, its outer proof, to the bucket as one more row; then DuckDB folds each document's
proof from its leaf to the root.

Defined cases: null ids and the null source come first; rows of one id are ordered by their leaf; a lone leaf is its
source's subroot, a lone subroot the root; an empty table gives an empty result; tampering lower-cases A-Z of the text
where 5 divides the CRC-32 of the id as decimal text, never for null ids; other columns are ignored. Only digests move,
texts are hashed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_sized, lower_ascii, map_arrow, materialise

FAN_BITS = 4
#: Levels of a bucket: 4096 leaves.
BUCKET_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many is tampered with before its proof is checked.
TAMPER = 5
#: Leaves that DuckDB gets at once, at least, but for the last block of a task; a bucket more at most.
BLOCK = 4096
DUCKDB_MEMORY = "256MB"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """A document's leaf, with ``text`` as its text."""
    return F.sha2(F.concat(*[_field(F.col(f"`{c}`")) for c in FIELDS if c != "text"], _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the leaf after tampering where that is due, else null."""
    due = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", leaf(F.col("text")).alias("leaf"), F.when(due, leaf(lower_ascii(F.col("text")))).alias("tampered"))


def levels(n: Column) -> Column:
    """Levels until ``n`` nodes have become one; exact, by the bits of n - 1."""
    bits = F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
    return F.ceil(bits / FAN_BITS).cast("int")


def place(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with the number ``s`` of their source, ``bucket``, ``pos`` and ``height`` of it; and the table of sources.

    Places come from a sort by ranges and the row counts of its partitions, so no source meets in one task.
    """
    ordered = materialise(rows.orderBy(F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf").withColumn("m", F.monotonically_increasing_id()), "merkle-ordered")
    # One row per partition and source: small, as a partition holds a range of sources.
    part = F.shiftright("m", 33)
    runs = ordered.groupBy(part.alias("p"), "source").agg(F.count(F.lit(1)).alias("rows"), F.min("m").alias("first"))
    # Windows over sources see one row per source and partition.
    by_source = Window.orderBy(F.asc_nulls_first("source"))
    sizes = runs.groupBy("source").agg(F.sum("rows").alias("n")).withColumn("s", F.row_number().over(by_source).cast("long") - 1)
    sources = materialise(sizes, "merkle-sources")
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A run is a partition's part of a source; its key is a text, so that the null source joins as any other.
    key = F.concat_ws("", F.col("p"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).alias("run")
    named = sources.select(F.col("source").alias("name"), "s", "n")
    based = runs.withColumn("base", before - F.col("first")).join(named, F.col("source").eqNullSafe(F.col("name")))
    based = materialise(based.select(key, "s", "n", "rows", "base"), "merkle-runs")
    rank = F.col("m") + F.col("base")
    found = join_sized(ordered.withColumn("p", part).withColumn("run", key), based, "run", "rows", 80)
    bits = FAN_BITS * BUCKET_LEVELS
    out = found.select(
        "s",
        F.shiftright(rank, bits).alias("bucket"),
        rank.bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("pos"),
        F.least(levels(F.col("n")), F.lit(BUCKET_LEVELS)).alias("height"),
        "doc_id",
        "leaf",
        "tampered",
    )
    return out, sources


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from rows that are sorted by source and bucket."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append(batch)
        if sum(b.num_rows for b in pending) < BLOCK:
            continue
        table = pa.Table.from_batches(pending)
        s, bucket = (table.column(c).to_numpy() for c in ("s", "bucket"))
        last = np.flatnonzero((s[1:] != s[:-1]) | (bucket[1:] != bucket[:-1]))
        if len(last):
            cut = int(last[-1]) + 1
            yield table.slice(0, cut)
            pending = table.slice(cut).to_batches()
    if pending:
        yield pa.Table.from_batches(pending)


def _engine() -> duckdb.DuckDBPyConnection:
    """DuckDB in the task's memory: one thread, and no files beside it."""
    con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
    con.execute("SET enable_progress_bar = false")
    return con


#: The nodes of a bucket, level by level; a bucket that is lower than the level keeps its one node.
_NODES = ["n0 AS (SELECT s, bucket, pos, height, leaf AS h FROM leaves WHERE pos >= 0)"] + [
    f"""r{k} AS (SELECT s, bucket, pos >> {FAN_BITS} AS pos, any_value(height) AS height, string_agg(h, '' ORDER BY pos) AS run FROM n{k} GROUP BY s, bucket, pos >> {FAN_BITS}),
n{k + 1} AS (SELECT s, bucket, pos, height, CASE WHEN height > {k} THEN sha256(run) ELSE run END AS h FROM r{k})"""
    for k in range(BUCKET_LEVELS)
]
_ROOTS = f"WITH {', '.join(_NODES)} SELECT s, bucket, h AS root FROM n{BUCKET_LEVELS}"


def _proofs(outer: int) -> str:
    """The query that folds the leaves of a block: inner levels by runs, then ``outer`` levels by the buckets' outer proofs."""
    parts = [*_NODES, "o AS (SELECT s, bucket, lefts, rights, subroot, root FROM leaves WHERE pos < 0)"]
    parts.append("p0 AS (SELECT s, bucket, pos AS place, height, doc_id, leaf, coalesce(tampered, leaf) AS f, '' AS told FROM leaves WHERE pos >= 0)")
    for k in range(BUCKET_LEVELS):
        own = f"64 * ((p.place >> {FAN_BITS * k}) & {(1 << FAN_BITS) - 1})"
        cut = f"SELECT p.*, r.run, substr(r.run, 1, {own}) AS l, substr(r.run, {own} + 65) AS g FROM p{k} p JOIN r{k} r ON p.s = r.s AND p.bucket = r.bucket AND p.place >> {FAN_BITS * (k + 1)} = r.pos"
        up = f"p.height > {k}"
        parts.append(f"c{k} AS ({cut})")
        parts.append(f"p{k + 1} AS (SELECT s, bucket, place, height, doc_id, leaf, CASE WHEN {up} THEN sha256(l || f || g) ELSE f END AS f, CASE WHEN {up} THEN told || l || g ELSE told END AS told FROM c{k} p)")
    last = f"p{BUCKET_LEVELS}"
    parts.append(f"q0 AS (SELECT p.doc_id, p.leaf, p.f, p.told, o.lefts, o.rights, o.subroot, o.root FROM {last} p JOIN o ON p.s = o.s AND p.bucket = o.bucket)")
    for k in range(outer):
        sides = f"len(lefts) > {k}"
        parts.append(f"q{k + 1} AS (SELECT doc_id, leaf, lefts, rights, subroot, root, CASE WHEN {sides} THEN sha256(lefts[{k + 1}] || f || rights[{k + 1}]) ELSE f END AS f, CASE WHEN {sides} THEN told || lefts[{k + 1}] || rights[{k + 1}] ELSE told END AS told FROM q{k})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(told) AS proof_sha256, f AS folded_root, f = root AS verified FROM q{outer}"


def _run(rows: DataFrame, schema: str, outer: bool) -> DataFrame:
    """A level query over the whole buckets of ``rows``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        try:
            for table in blocks(batches):
                con.register("leaves", table)
                most = pc.max(pc.list_value_length(table.column("lefts"))).as_py() or 0 if outer else 0
                yield from con.execute(_proofs(most) if outer else _ROOTS).to_arrow_table().select(names).cast(want).to_batches()
                con.unregister("leaves")
        finally:
            con.close()

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    want = pa.schema([(c.strip().split(" ")[0], kinds[c.strip().split(" ")[1]]) for c in schema.split(",")])
    return map_arrow(rows.repartition("s", "bucket").sortWithinPartitions("s", "bucket", "pos"), work, schema, owner="merkle")


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(g, at, n, h): nodes of trees g with n nodes each -> (g, h) of their roots, and each level's (g, at, left, right).

    ``most``: the largest n. A run has at most FAN nodes, and levels shrink by FAN, whatever the size of a tree.
    """
    paths = []
    while most > 1:
        many = F.col("n") > 1
        kids = F.array_sort(F.collect_list(F.struct("at", "h")))
        runs = nodes.where(many).groupBy("g", F.shiftright("at", FAN_BITS).alias("up"), "n").agg(kids.alias("kids"))
        runs = materialise(runs, "merkle-runs")

        def joined(part: Column) -> Column:
            return F.array_join(F.transform(part, lambda x: x["h"]), "")

        sides = runs.select("g", F.posexplode("kids").alias("k", "kid"), "kids")
        size = F.size("kids")
        sides = sides.select("g", F.col("kid.at").alias("at"), joined(F.slice("kids", 1, F.col("k"))).alias("left"), joined(F.slice("kids", F.col("k") + 2, size)).alias("right"))
        paths.append(materialise(sides, "merkle-sides"))
        up = runs.select("g", F.col("up").alias("at"), F.ceil(F.col("n") / (1 << FAN_BITS)).cast("long").alias("n"), F.sha2(joined(F.col("kids")), 256).alias("h"))
        nodes = materialise(nodes.where(~many).unionByName(up), "merkle-nodes")
        most = -(-most >> FAN_BITS)
    return nodes.select("g", "h"), paths


def _with_sides(rows: DataFrame, paths: list[DataFrame], group: Column, at: Column) -> DataFrame:
    """``rows`` (with arrays lefts and rights) and what stands beside the path up from node ``at`` of tree ``group``."""
    rows = rows.withColumn("__g", group).withColumn("__at", at)
    for sides in paths:
        named = sides.select(F.col("g").alias("__of"), F.col("at").alias("__in"), "left", "right")
        found = rows.join(named, (F.col("__g") == F.col("__of")) & (F.col("__at") == F.col("__in")), "left")
        add = {c: F.when(F.col(side).isNull(), F.col(c)).otherwise(F.concat(c, F.array(side))) for c, side in (("lefts", "left"), ("rights", "right"))}
        rows = found.withColumns(add).drop("__of", "__in", "left", "right").withColumn("__at", F.shiftright("__at", FAN_BITS))
    return rows.drop("__g", "__at")


class Manifest:
    """The written tables of a dataset's tree: placed leaves, sources with their subroots, buckets with outer proofs."""

    def __init__(self, spark: SparkSession, placed: DataFrame, sources: DataFrame, outer: DataFrame, root: str | None):
        self.spark, self.placed, self.sources, self.outer, self.root = spark, placed, sources, outer, root

    def proofs(self) -> DataFrame:
        """A row per document: its leaf, subroot, root, the digest of its siblings, the root folded from it, and whether that is the root."""
        none = F.lit(None)
        rows = self.placed.withColumns({"lefts": none.cast("array<string>"), "rights": none.cast("array<string>"), "subroot": none.cast("string"), "root": none.cast("string")})
        heads = self.outer.select(
            "s", "bucket", F.lit(-1).alias("pos"), F.lit(0).alias("height"), none.cast("long").alias("doc_id"), none.cast("string").alias("leaf"), none.cast("string").alias("tampered"), "lefts", "rights", "subroot", "root"
        )
        return _run(rows.unionByName(heads), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", True)


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text)."""
    spark = docs.sparkSession
    placed, sources = place(materialise(leaves(docs), "merkle-leaves"))
    placed = materialise(placed, "merkle-placed")
    roots = materialise(_run(placed, "s long, bucket long, root string", False), "merkle-roots")
    bits = FAN_BITS * BUCKET_LEVELS
    per = sources.select(F.col("s").alias("g"), F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"))
    most = per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("sources")).first()
    tops, inner = climb(join_sized(roots.select(F.col("s").alias("g"), F.col("bucket").alias("at"), F.col("root").alias("h")), per, "g", "n", 24), most.most)
    named = materialise(sources.join(tops, sources["s"] == tops["g"]).select("source", "s", "n", F.col("h").alias("subroot")), "merkle-subroots")
    one = F.lit(0).cast("long").alias("g")
    root, above = climb(named.select(one, F.col("s").alias("at"), F.lit(most.sources).cast("long").alias("n"), F.col("subroot").alias("h")), most.sources)
    found = root.first()
    empty = F.array().cast("array<string>")
    outer = _with_sides(roots.select("s", "bucket", empty.alias("lefts"), empty.alias("rights")), inner, F.col("s"), F.col("bucket"))
    ends = _with_sides(named.select("s", "n", "subroot", empty.alias("lefts"), empty.alias("rights")), above, F.lit(0).cast("long"), F.col("s"))
    ends = materialise(ends.select("s", F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), "subroot", F.col("lefts").alias("l"), F.col("rights").alias("r")), "merkle-ends")
    outer = join_sized(outer, ends, "s", "n", 2000)
    outer = outer.select("s", "bucket", F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"), "subroot", F.lit(found.h if found else None).cast("string").alias("root"))
    return Manifest(spark, placed, named, materialise(outer, "merkle-outer"), found.h if found else None)
