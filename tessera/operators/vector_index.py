"""Dense retrieval with an index (survey R1): coarse cells, every vector in one, queries sent to the nearest ones.

``retrieve.top_k`` compares each query with each vector; here a query meets only the vectors of the cells that it probes.
Cells are centres fitted on a bounded sample (SAMPLE_BYTES of vectors, at most PER_CELL a cell); all vectors are
assigned. A cell is cut into parts of about PART rows by a hash of the id, so a cell that holds a third of all vectors,
copies of one say, is no hot spot: a task holds one part and streams the queries that probe it. How many cells a query
probes is calibrated: for a bounded sample of queries the true neighbours are searched in all vectors, and the least
number of cells that holds the wanted share of them is taken. ``certified`` results are exact: cells whose bound, the
product with the centre plus the radius, does not rule out a better neighbour are probed too.

Rows without a vector, or with one of another length than the first, are not indexed and, as queries, find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import written

from .retrieve import top_k

#: The sample that centres are fitted on, and vectors of it for each cell at most.
SAMPLE_BYTES = 32 << 20
PER_CELL = 64
#: Cells, about the square root of the number of vectors.
MOST_CELLS = 4096
ROUNDS = 8
#: Rows of a part of a cell.
PART = 8192
#: Queries whose true neighbours calibrate the number of probes.
CALIBRATION = 256
#: Vectors that are compared at once with the centres, or queries with a part.
STEP = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Centres of ``cells`` groups of near vectors; a group that has lost all its vectors keeps its centre."""
    distinct = np.unique(sample, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[:cells]
    centres = distinct[np.sort(pick)]
    for _ in range(rounds):
        own = nearest(sample, centres)
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        centres[found] = sums / np.diff(np.append(first, len(sample)))[:, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre at the least distance of each vector."""
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(vectors[k : k + STEP] @ centres.T - half, axis=1) for k in range(0, len(vectors), STEP)] or [np.zeros(0, np.int64)])


class VectorIndex:
    """Centres with the radius, rows and parts of their cells, and the written table of assigned vectors."""

    def __init__(self, spark: SparkSession, rows: DataFrame, centres: np.ndarray, radius: np.ndarray, parts: np.ndarray, probes: int):
        self.spark, self.rows, self.centres, self.radius, self.parts, self.probes = spark, rows, centres, radius, parts, probes

    def _routed(self, queries: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
        """(cell, part, query, vector) of the cells that each query probes; ``beyond``: of further cells that may hold better than ``worst``."""
        # At most MOST_CELLS centres.
        held = self.spark.sparkContext.broadcast((self.centres, self.radius, self.parts))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, parts = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    piece = batch.slice(at, STEP)
                    vectors = _matrix(piece.column(1))
                    scores = vectors @ centres.T
                    order = np.argsort(-scores, axis=1, kind="stable")
                    chosen = np.zeros(scores.shape, bool)
                    np.put_along_axis(chosen, order[:, :probes], True, axis=1)
                    if beyond:
                        worst = piece.column(2).to_numpy(zero_copy_only=False)
                        bound = scores + np.linalg.norm(vectors, axis=1)[:, None] * radius + 1e-9
                        chosen = ~chosen & (bound >= worst[:, None])
                    row, cell = np.nonzero(chosen & (parts > 0))
                    times = parts[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    part = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                    for low in range(0, len(row), STEP):
                        cut = slice(low, low + STEP)
                        yield pa.RecordBatch.from_arrays([pa.array(cell[cut].astype(np.int64)), pa.array(part[cut].astype(np.int64)), piece.column(0).take(pa.array(row[cut])), piece.column(1).take(pa.array(row[cut]))], names=["cell", "part", "id", "vector"])

        return queries.mapInArrow(route, "cell long, part long, id long, vector array<double>")

    def _candidates(self, routed: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): the best k of each part that a query meets.

        Rows of a part come before its queries, so a task holds one part and streams the queries.
        """
        both = self.rows.select("cell", "part", F.lit(0).alias("kind"), "id", "vector").unionByName(routed.select("cell", "part", F.lit(1).alias("kind"), "id", "vector"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, blocks, vectors = None, [], [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, part, kind = (batch.column(c).to_numpy() for c in range(3))
                cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
                for low, high in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                    if at != (cell[low], part[low]):
                        at, ids, blocks, vectors = (cell[low], part[low]), [], [], None
                    piece = batch.slice(low, high - low)
                    if kind[low] == 0:
                        ids.append(piece.column(3).to_numpy())
                        blocks.append(_matrix(piece.column(4)))
                        continue
                    if not blocks:
                        continue
                    if vectors is None:
                        names, vectors = np.concatenate(ids), np.concatenate(blocks)
                        order = np.argsort(names, kind="stable")
                        names, vectors = names[order], vectors[order]
                    for step in range(0, piece.num_rows, STEP):
                        own = piece.slice(step, STEP)
                        asked, scores = own.column(3).to_numpy(), _matrix(own.column(4)) @ vectors.T
                        scores[asked[:, None] == names[None, :]] = -np.inf
                        # Ids ascend, so the stable order breaks ties by them.
                        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                        found = np.take_along_axis(scores, best, 1)
                        real = np.isfinite(found)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, real.sum(axis=1))), pa.array(names[best][real]), pa.array(found[real])], names=["query_id", "id", "score"])

        return both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(search, "query_id long, id long, score double")

    def search(self, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding", probes: int | None = None, certified: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the k best vectors of the probed cells, ties by id; a query's own row is out."""
        size, probes = self.centres.shape[1], probes or self.probes
        asked = _vectors(queries, id_col, vector, size)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")

        def ranked(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        found = self._candidates(self._routed(asked, probes), k)
        if not certified:
            return ranked(found)
        first = written(ranked(found).drop("rank"), "index-first")
        worst = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
        # Fewer than k neighbours so far rule nothing out.
        limit = F.when(F.coalesce(F.col("n"), F.lit(0)) < k, F.lit(float("-inf"))).otherwise(F.col("worst"))
        open_ = asked.join(worst, F.col("id") == F.col("query_id"), "left").select("id", "vector", limit.alias("worst"))
        return ranked(first.unionByName(self._candidates(self._routed(open_, probes, beyond=True), k)))


def _vectors(rows: DataFrame, id_col: str, vector: str, size: int | None = None) -> DataFrame:
    """(id, vector) of the rows that can be compared."""
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return named.where(whole & (F.size("vector") > 0 if size is None else F.size("vector") == size))


def build_index(corpus: DataFrame, k: int = 3, recall: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, part_rows: int = PART) -> VectorIndex:
    """Index all vectors of ``corpus``; ``recall``: the share of the sample queries' k neighbours that the probed cells must hold."""
    spark = corpus.sparkSession
    first = _vectors(corpus, id_col, vector).limit(1).collect()
    if not first:
        none = spark.createDataFrame([], "id long, vector array<double>, cell long, part long")
        return VectorIndex(spark, none, np.zeros((1, 1)), np.zeros(1), np.zeros(1, np.int64), 1)
    size = len(first[0].vector)
    whole = _vectors(corpus, id_col, vector, size)
    n = whole.count()
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS)
    most = max(cells, min(PER_CELL * cells, SAMPLE_BYTES // (8 * size)))
    # The sample is the rows of the smallest hashes of their ids, whatever the order of rows.
    share = min(1.0, 1.2 * most / n + 1e-6)
    near = whole.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = np.array([r.vector for r in near.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").collect()] or [first[0].vector])
    centres = fit_centres(sample, cells)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            own = nearest(vectors, held.value)
            away = np.linalg.norm(vectors - held.value[own], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int64)), pa.array(away)], names=["id", "vector", "cell", "away"])

    assigned = written(whole.mapInArrow(assign, "id long, vector array<double>, cell long, away double"), "index-assigned")
    # A row per cell.
    held_by = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    radius, parts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in held_by:
        radius[r.cell], parts[r.cell] = r.radius, -(-r.n // part_rows)
    # At most MOST_CELLS rows.
    cut = spark.createDataFrame([(k, int(p)) for k, p in enumerate(parts)], "__cell long, __parts long")
    rows = assigned.join(F.broadcast(cut), F.col("cell") == F.col("__cell")).select("id", "vector", "cell", F.pmod(F.xxhash64("id"), "__parts").cast("bigint").alias("part"))
    index = VectorIndex(spark, rows, centres, radius, parts, 1)
    index.probes = _calibrate(index, whole, k, recall)
    return index


def _calibrate(index: VectorIndex, whole: DataFrame, k: int, recall: float) -> int:
    """The least number of probes whose cells hold ``recall`` of the true neighbours of CALIBRATION vectors."""
    asked = whole.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(CALIBRATION)
    asked = written(asked, "index-asked")
    # At most k rows for each of them.
    true = written(top_k(asked, index.rows, k, "id", "vector").select("query_id", F.col("id").alias("__true")), "index-true")
    found = index.rows.join(F.broadcast(true), F.col("id") == F.col("__true")).select("query_id", "cell").collect()
    if not found:
        return 1
    vectors = {r.id: r.vector for r in asked.collect()}
    names = sorted(vectors)
    order = np.argsort(-(np.array([vectors[i] for i in names]) @ index.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = {i: row for row, i in enumerate(names)}
    needed = np.sort([place[at[r.query_id], r.cell] + 1 for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
