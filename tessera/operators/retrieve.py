"""Dense retrieval (survey R1): exact top-k by inner product, in blocks, without a cross join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are handed to the tasks at once; further ones take further passes.
BLOCK = 4096


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, id, score) of the k corpus vectors of greatest inner product, ties by id; a query's own row is out.

    Queries go to the tasks in blocks of bounded size; a task multiplies a batch of corpus vectors with the block and
    keeps k candidates per query, so that only tasks x queries x k rows are ranked in the end.
    """
    n = queries.count()
    parts, out = max(1, -(-n // block)), None
    schema = "query_id long, id long, score double"
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).select(id_col, vector).collect()
        if not rows:
            continue
        held = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def score(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, block_ = held.value
            best_score, best_id = np.full((len(ids), 0), -np.inf), np.full((len(ids), 0), 0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                vectors = np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_numpy(zero_copy_only=False)])
                found = block_ @ vectors.T
                found[ids[:, None] == own[None, :]] = -np.inf
                scores, names = np.concatenate([best_score, found], axis=1), np.concatenate([best_id, np.broadcast_to(own, found.shape)], axis=1)
                order = np.lexsort((names, -scores), axis=1)[:, :k]
                best_score, best_id = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
            if best_score.shape[1]:
                real = np.isfinite(best_score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(best_id[real]), pa.array(best_score[real])], names=["query_id", "id", "score"])

        found = corpus.select(F.col(id_col).cast("bigint"), vector).mapInArrow(score, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], schema)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
