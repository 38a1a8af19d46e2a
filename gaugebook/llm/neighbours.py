"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into tiles: codes (int8), scale, error norm and originals. Every query
tile meets every candidate tile of its dimension. Within a pair of tiles one product of
codes gives approximate distances; with the error norms of both sides they bound the true
distance from below and above. Candidates whose lower bound exceeds the k-th upper bound
of the query cannot be among its nearest in the tile; the rest are computed from the
originals in double precision. Each task keeps one heap per query over the tiles it sees;
the last merge ranks what the tasks kept.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; vectors of another dimension are no candidates of a query; rows with equal
vec_id are separate candidates, but never of a query with that id; ties go to the smaller
vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096
QUERY_TILE = 512


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors["embedding"].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _tiles(vectors: DataFrame, rows: int, prefix: str) -> DataFrame:
    """One row per tile: dimension, number, ids and vectors as binary."""
    counted = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    sizes = counted.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("tiles"))
    dealt = counted.join(sizes, "dim").withColumn(
        "tile", F.pmod(F.xxhash64("vec_id", "v"), F.col("tiles")).cast("int"))
    return dealt.groupBy("dim", "tile").agg(
        F.collect_list(F.struct("vec_id", "v")).alias(prefix), F.first("tiles").alias(f"{prefix}_tiles")
    ).withColumnRenamed("tile", f"{prefix}_tile")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes under one scale a row, and the norm of what quantisation lost."""
    scale = np.abs(x).max(1, keepdims=True) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale).astype(np.int8)
    approx = codes * scale
    return codes, scale[:, 0], np.sqrt(((x - approx) ** 2).sum(1))


def tile_nearest(q_ids, q, c_ids, c, k: int):
    """For each query of a tile: (distance, vec_id) of its k nearest in a candidate tile."""
    qc, qs, qe = quantised(q)
    cc, cs, ce = quantised(c)
    # Products of int8 are exact in float32 up to 1,040 dimensions, in float64 beyond.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    dot = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    qn = ((qc * qs[:, None]) ** 2).sum(1)
    cn = ((cc * cs[:, None]) ** 2).sum(1)
    middle = np.sqrt(np.maximum(qn[:, None] + cn[None, :] - 2 * dot, 0))
    # Rounding of the approximate form itself, on top of what quantisation lost.
    blur = (qe[:, None] + ce[None, :]) + 1e-6 * (np.sqrt(qn)[:, None] + np.sqrt(cn)[None, :])
    lower, upper = middle - blur, middle + blur
    own = q_ids[:, None] == c_ids[None, :]
    upper[own] = np.inf
    lower[own] = np.inf
    kth = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
    for i in range(len(q_ids)):
        near = np.flatnonzero((lower[i] <= kth[i]) & ~own[i])
        exact = np.sqrt(((q[i] - c[near]) ** 2).sum(1))
        order = np.lexsort((c_ids[near], exact))[:k]
        yield i, list(zip(exact[order].tolist(), c_ids[near[order]].tolist()))


def _matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one tile from its Arrow list."""
    fields = rows.values if hasattr(rows, "values") else rows
    ids = fields.field("vec_id").to_numpy(zero_copy_only=False)
    flat = fields.field("v").flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tile: int = TILE,
            query_tile: int = QUERY_TILE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other vectors of each query.

    `is_query` is a condition on `vec_id`.
    """
    good = usable(vectors)
    candidates = _tiles(good, tile, "c")
    queries = _tiles(good.where(is_query), query_tile, "q").drop("q_tiles")
    counts = good.select(F.size("v").alias("dim")).groupBy("dim").agg(
        F.ceil(F.count("*") / tile).cast("int").alias("n"))
    # A query tile is sent once to each candidate tile of its dimension.
    sent = queries.join(counts, "dim").withColumn(
        "c_tile", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    pairs = sent.join(candidates, ["dim", "c_tile"]).select("q", "c")
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")

    def products(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q = _matrix(batch.column("q")[i].values)
                c_ids, c = _matrix(batch.column("c")[i].values)
                for at, found in tile_nearest(q_ids, q, c_ids, c, k):
                    held = heaps.setdefault(int(q_ids[at]), [])
                    for distance, vec_id in found:
                        item = (-distance, -vec_id)
                        if len(held) < k:
                            heapq.heappush(held, item)
                        elif item > held[0]:
                            heapq.heapreplace(held, item)
            if len(heaps) > 16 * query_tile:  # a task that sees many queries hands on what it has
                yield _kept(heaps)
                heaps = {}
        if heaps:
            yield _kept(heaps)

    kept = pairs.mapInArrow(products, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _kept(heaps: dict[int, list]) -> pa.RecordBatch:
    rows = [(q, -v, -d) for q, held in heaps.items() for d, v in held]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
        names=["query_id", "vec_id", "score"])
