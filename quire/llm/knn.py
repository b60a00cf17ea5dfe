"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are turned into whole numbers, and the largest inner products are found as nearest neighbours:
with one more coordinate sqrt(R^2 - |x|^2) for data (R: the largest norm) and 0 for queries, squared
distance is |q|^2 + R^2 - 2 q.x.  Data and queries are assigned to the nearest of a few pivots.  From one
summary row per pivot (the farthest distance, and ids and distances of its k + 1 nearest ids) follows for
each group of queries a distance within which all their neighbours lie: that of the k + 1 nearest ids, as
rows of one id alone can be the query's own; a data row is replicated to a
query group only if the triangle inequality lets it come that near.  A group is searched locally, and the
k best of each part are merged.

A group's queries are cut into blocks of ``QUERY_BLOCK``, and the data that meets a block into
``salts`` parts, so that a pivot with a third of all rows is no single task.  A part streams its data in
Arrow batches and holds k rows per query.  What goes through the driver has fixed bounds: the pivots and
one summary row for each.  Scores are exact integers whatever the pivots are.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take
no part; a shorter vector counts as followed by zeros; rows that repeat an id are candidates one by one,
as a query the first of them by value is taken; a query never meets rows of its own id; scores beyond
64 bits are cut to the largest value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import keep, parts

PIVOTS = 32
QUERY_BLOCK = 2048
#: Data rows of one local search.
DATA_BLOCK = 100_000
#: Added to every bound: more than the rounding of distances in double precision.
SLACK = 1e-6


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    cast = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(cast, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull() | bad, None).otherwise(F.transform(cast, lambda x: F.floor(x * scale).cast("long")))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of lists, shorter ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def lifted(x: np.ndarray, square: float | None) -> np.ndarray:
    """With the further coordinate: for data (``square``: R^2), or 0 for queries."""
    x = x.astype(np.float64)
    more = np.zeros(len(x)) if square is None else np.sqrt(np.maximum(square - (x**2).sum(1), 0))
    return np.concatenate([x, more[:, None]], 1)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where all sums stay below 2^53."""
    width = max(1, queries.shape[1])
    # As floats: the absolute value of the least long has no place among longs.
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(data.astype(np.float64)).max(initial=0)) * width
    if most < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return queries @ data.T
    out = np.array([[min(max(sum(map(int.__mul__, q, d)), -(2**63)), 2**63 - 1) for d in data.tolist()] for q in queries.tolist()], dtype=np.int64)
    return out.reshape(len(queries), len(data))


def assigned(df: DataFrame, pivots: np.ndarray, square: float | None) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = sent.value
        for batch in stream:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                far = distances(lifted(dense(part.column("v"), points.shape[1] - 1), square), points)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], ["id", "v", "pivot", "far"])

    return df.select("id", "v").mapInArrow(run, "id long, v array<long>, pivot int, far double")


def windows(pivots: np.ndarray, data: list, queries: list, k: int) -> list[tuple[int, int, float]]:
    """(query pivot, data pivot, least distance to the data pivot) of all groups that have to meet."""
    between = distances(pivots, pivots)
    out = []
    for i, reach in queries:
        # Farthest that the k + 1 nearest ids can be, from the summaries alone; one of them may be the query's own.
        bounds = np.concatenate([reach + between[i, j] + np.array([far for far, _ in nearest]) for j, _, nearest in data])
        ids = np.concatenate([np.array([own for _, own in nearest], np.int64) for _, _, nearest in data])
        order = np.argsort(bounds, kind="stable")
        first = np.sort(np.unique(ids[order], return_index=True)[1])
        theta = bounds[order[first[k]]] if len(first) > k else np.inf
        for j, most, _ in data:
            least = between[i, j] - reach - theta - SLACK * (1 + between[i, j] + reach)
            if most >= least:
                out.append((i, j, float(max(least, -1.0))))
    return out


def search(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query, ties to the smaller id."""
    spark = df.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("asks"))
    rows = keep(rows.where("v is not null"), "knn-vectors")
    square, width, n, asked = rows.agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.max(F.size("v")), F.count("*"), F.count_if("asks")
    ).first()
    if not asked:
        return spark.createDataFrame([], empty)
    # Any pivots give exact results; those with the smallest hashes of their ids spread like the data.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").toArrow()["v"].combine_chunks()
    pivots = np.unique(lifted(dense(sample, width), square), axis=0)
    data = assigned(rows, pivots, square)
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = keep(assigned(queries, pivots, None), "knn-queries")
    data = keep(data, "knn-data")
    near = _nearest(data, k + 1)
    summary = [(r.pivot, r.most, r.near) for r in near.collect()]
    asking = queries.groupBy("pivot").agg(F.max("far").alias("reach"), F.count("*").alias("n")).collect()
    met = windows(pivots, summary, [(r.pivot, r.reach) for r in asking], k)
    blocks = {r.pivot: -(-r.n // QUERY_BLOCK) for r in asking}
    plan = spark.createDataFrame([(i, j, least, blocks[i]) for i, j, least in met], "q int, pivot int, least double, blocks int")
    salts = max(1, min(parts(spark), -(-n // DATA_BLOCK)))
    place = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    block = F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")
    sent = data.join(F.broadcast(plan), "pivot").where("far >= least").select("q", block, place, "id", "v", F.lit(False).alias("asks"))
    sizes = spark.createDataFrame(list(blocks.items()), "pivot int, blocks int")
    own = queries.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ask = own.select(F.col("pivot").alias("q"), "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "id", "v", F.lit(True).alias("asks"))
    cells = sent.unionByName(ask).repartition(parts(spark), "q", "block", "salt").sortWithinPartitions("q", "block", "salt", F.desc("asks"), "id")
    best = cells.mapInArrow(_local(k, width), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _nearest(data: DataFrame, k: int) -> DataFrame:
    """Per pivot: the farthest distance, and the k ids with the smallest ones, each task's share first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64)
        for batch in stream:
            pivot, far, own = (np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(kept, ("pivot", "far", "id")))
            order = np.lexsort((far, own, pivot))
            pivot, far, own = pivot[order], far[order], own[order]
            nearest = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (own[1:] != own[:-1])])[: len(own)]
            pivot, far, own = pivot[nearest], far[nearest], own[nearest]
            order = np.lexsort((own, far, pivot))
            pivot, far, own = pivot[order], far[order], own[order]
            few = np.arange(len(pivot)) - np.searchsorted(pivot, pivot) < k
            kept = pivot[few], far[few], own[few]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1]), pa.array(kept[2])], ["pivot", "far", "id"])

    ids = data.select("pivot", "far", "id").mapInArrow(run, "pivot int, far double, id long").groupBy("pivot", "id").agg(F.min("far").alias("far"))
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("pivot").orderBy("far", "id"))).where(F.col("n") <= k)
    near = few.groupBy("pivot").agg(F.collect_list(F.struct("far", "id")).alias("near"))
    return data.groupBy("pivot").agg(F.max("far").alias("most")).join(near, "pivot")


def _local(k: int, width: int):
    """Streams cells, queries first: keeps the k best rows of each query of the open cell."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, block = None, None, None
        top_ids = top_scores = None

        def closed():
            rows, places = np.nonzero(top_ids != _NONE)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(top_ids[rows, places]), pa.array(top_scores[rows, places])], ["query_id", "vec_id", "score"]
            )

        for batch in stream:
            cell = np.stack([batch.column(c).to_numpy() for c in ("q", "block", "salt")], 1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1) | (asks[1:] != asks[:-1])]))
            for at, to in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                now = tuple(cell[at].tolist())
                if now != key:
                    if key is not None and len(ids):
                        yield closed()
                    key, ids, block = now, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
                    top_ids, top_scores = np.zeros((0, k), np.int64), np.zeros((0, k), np.int64)
                for lo in range(at, to, 2048):
                    part = batch.slice(lo, min(2048, to - lo))
                    own, vectors = part.column("id").to_numpy(), dense(part.column("v"), width)
                    if asks[at]:
                        ids, block = np.concatenate([ids, own]), np.concatenate([block, vectors])
                        top_ids = np.full((len(ids), k), _NONE)
                        top_scores = np.full((len(ids), k), np.iinfo(np.int64).min)
                    elif len(ids):
                        top_ids, top_scores = _merge(ids, top_ids, top_scores, own, scores(block, vectors), k)
        if key is not None and len(ids):
            yield closed()

    return run


_NONE = np.iinfo(np.int64).max


def _merge(ids, top_ids, top_scores, own, found, k):
    """The k best of what is kept and what is new: by score, then by smaller id."""
    mine = own[None, :] == ids[:, None]
    if found.shape[1] > k:
        # Rows below the k-th best of this batch can't be among the best; equals of it stay.
        edge = np.partition(np.where(mine, np.iinfo(np.int64).min, found), found.shape[1] - k, axis=1)[:, found.shape[1] - k]
        ahead = (found >= np.maximum(edge, top_scores[:, -1])[:, None]) & ~mine
    else:
        ahead = ~mine
    for row in np.flatnonzero(ahead.any(1)):
        new = np.flatnonzero(ahead[row])
        all_ids = np.concatenate([top_ids[row], own[new]])
        all_scores = np.concatenate([top_scores[row], found[row, new]])
        # An empty place has the largest id and the least score; ~score orders descending without overflow.
        order = np.lexsort((all_ids, ~all_scores))[:k]
        top_ids[row], top_scores[row] = all_ids[order], all_scores[order]
    return top_ids, top_scores


def report(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows of every row whose id is divisible by ``every``."""
    return search(df, vec_id, vector, F.col(vec_id) % every == 0, k)
