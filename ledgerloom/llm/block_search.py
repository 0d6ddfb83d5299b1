"""Exact nearest neighbours by a block matrix join with int8 tiles.

Every vector is quantised to int8 codes once, and only codes travel: rows are dealt to blocks by a hash of their id, and
every block of queries meets every block of candidates of the same dimension once, tile by tile. A tile multiplies codes (sums of at
most ``STRETCH`` products are exact in float32, so a float matrix product computes them) and adds the largest error that
rounding can have made: with ``x = a + r``, ``y = b + s`` (codes a, b and rests r, s), ``|xy - ab| <= |a||s| + |r||y|``. A
pair whose upper bound is below the k-th best lower bound of its query is out; this floor rises from tile to tile of a
block, and then over all blocks. The originals of the pairs that are left are fetched by joins and multiplied in double precision; heaps merge them.

Inner products, larger is nearer, ties to the smaller id. Vectors that are null, empty, zero or hold a null or
non-finite component take no part, nor do rows without id. Rows with one id and dimension are one vector: the smallest by
its components counts. A query never finds its own id. Repeated queries give one result. Empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, written

#: Neighbours of a query, rows in a block of candidates, of them in a tile, rows in a block of queries, components whose
#: products are summed at once.
NEAREST, CANDIDATE_ROWS, TILE_ROWS, QUERY_ROWS, STRETCH = 20, 1 << 15, 2048, 1024, 1024

_FOUND = "query_id long, vec_id long, score double"
_CODED = "vec_id long, dim int, asks boolean, codes binary, scale double, norm double, rest double"
_BOUNDED = "query_id long, vec_id long, dim int, low double, high double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
        & F.exists("vector", lambda x: x != 0)
    ).withColumn("dim", F.size("vector"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, and bounds of the norms of the coded part and of the rest, by row."""
    largest = np.abs(x).max(axis=1)
    scale = largest / 127
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127).astype(np.int8)
    coded = codes * scale[:, None]
    up = 1 + 1e-9  # above the rounding of the norms themselves
    return codes, scale, np.sqrt((coded**2).sum(1)) * up, np.sqrt(((x - coded) ** 2).sum(1)) * up + 1e-12 * largest


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of int8 codes."""
    total = np.zeros((len(a), len(b)))
    for first in range(0, a.shape[1], STRETCH):
        total += a[:, first : first + STRETCH].astype(np.float32) @ b[:, first : first + STRETCH].T.astype(np.float32)
    return total


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, component after component, so equal vectors always score the same."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def coded(vectors: DataFrame) -> DataFrame:
    """int8 codes, scale and norms of the coded part and the rest of every vector (vec_id, vector, dim, asks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, dims, asks = batch.columns
            sizes = dims.to_numpy()
            for dim in np.unique(sizes).tolist():
                own = pa.array(sizes == dim)
                x = lists.filter(own).flatten().to_numpy().reshape(-1, dim)
                codes, scale, norm, rest = quantise(x)
                columns = [ids.filter(own), dims.filter(own), asks.filter(own), pa.array([c.tobytes() for c in codes], pa.binary()),
                           pa.array(scale), pa.array(norm), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _CODED.split(", ")])

    return vectors.select("vec_id", "vector", "dim", "asks").mapInArrow(run, _CODED)


def tiles(q: pa.Table, c: pa.Table, k: int) -> pa.Table:
    """The pairs of two blocks that may be among the k nearest of their query, with the bounds of their products."""

    def parts(side: pa.Table) -> tuple[np.ndarray, ...]:
        codes = np.frombuffer(b"".join(side.column("codes").to_pylist()), np.int8).reshape(side.num_rows, -1)
        return side.column("vec_id").to_numpy(), codes, *(side.column(name).to_numpy() for name in ("scale", "norm", "rest"))

    if not q.num_rows or not c.num_rows:
        return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(_BOUNDED.split(", "), _KINDS)})
    q_ids, q_codes, q_scale, q_norm, q_rest = parts(q)
    block = parts(c)
    best = np.full((len(q_ids), k), -np.inf)  # lower bounds of the k nearest so far
    found = []
    for first in range(0, c.num_rows, TILE_ROWS):
        c_ids, c_codes, c_scale, c_norm, c_rest = (column[first : first + TILE_ROWS] for column in block)
        near = int8_products(q_codes, c_codes) * q_scale[:, None] * c_scale[None, :]
        error = q_norm[:, None] * c_rest[None, :] + q_rest[:, None] * (c_norm + c_rest)[None, :]
        error += 1e-9 * (np.abs(near) + error)
        own = q_ids[:, None] == c_ids[None, :]
        low = np.where(own, -np.inf, near - error)
        best = np.partition(np.concatenate((best, low), axis=1), len(c_ids), axis=1)[:, len(c_ids) :]
        near += error
        rows, columns = np.nonzero((near >= best.min(axis=1)[:, None]) & ~own)
        found.append((rows, c_ids[columns], low[rows, columns], near[rows, columns]))
    rows, ids, low, high = (np.concatenate(column) for column in zip(*found))
    keep = high >= best.min(axis=1)[rows]
    values = (q_ids[rows[keep]], ids[keep], np.full(int(keep.sum()), q_codes.shape[1]), low[keep], high[keep])
    return pa.table({f.split()[0]: pa.array(v, t) for f, v, t in zip(_BOUNDED.split(", "), values, _KINDS)})


_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())


def above_floor(bounded: DataFrame, k: int) -> DataFrame:
    """Pairs whose upper bound reaches the k-th best lower bound of their query over all tiles.

    A query's pairs come in order of their lower bounds, so the floor is known after k of them and none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, place, floor = None, 0, -np.inf
        for batch in batches:
            ids, low, high = (batch.column(i).to_numpy() for i in (0, 3, 4))
            begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
            keep = np.zeros(len(ids), bool)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)]):
                if ids[a] != query:
                    query, place, floor = ids[a], 0, -np.inf
                if place < k <= place + b - a:
                    floor = low[a + k - place - 1]
                keep[a:b] = high[a:b] >= floor
                if place < k:
                    keep[a : min(b, a + k - place)] = True
                place += b - a
            yield batch.filter(pa.array(keep))

    ordered = bounded.repartition("query_id").sortWithinPartitions("query_id", F.desc("low"), "vec_id")
    return ordered.mapInArrow(run, _BOUNDED)


def rescored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the products of the original vectors in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(dims == dim)
                x, y = (batch.column(i).filter(own).flatten().to_numpy().reshape(-1, dim) for i in (3, 4))
                scores[dims == dim] = exact_products(x, y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query_id", "vec_id", "score"])

    c = vectors.select(F.col("vec_id").alias("c_id"), F.col("dim").alias("c_dim"), F.col("vector").alias("y"))
    q = vectors.where("asks").select(F.col("vec_id").alias("q_id"), F.col("dim").alias("q_dim"), F.col("vector").alias("x"))
    whole = pairs.join(c, (F.col("vec_id") == F.col("c_id")) & (F.col("dim") == F.col("c_dim"))).join(
        q, (F.col("query_id") == F.col("q_id")) & (F.col("dim") == F.col("q_dim")))
    return whole.select("query_id", "vec_id", "dim", "x", "y").mapInArrow(run, _FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which ``is_query`` holds, over (vec_id, vector)."""
    distinct = usable(vectors, id_column, vector_column).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    rows = written(distinct.withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    c_blocks, q_blocks = max(1, -(-sizes["rows"] // CANDIDATE_ROWS)), max(1, -(-sizes["queries"] // QUERY_ROWS))

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        )

    keys, codes = ["dim", "c_block", "q_block"], coded(rows)
    candidates = dealt(codes, "c_block", c_blocks, "q_block", q_blocks).groupBy(*keys)
    queries = dealt(codes.where("asks"), "q_block", q_blocks, "c_block", c_blocks).groupBy(*keys)
    bounded = queries.cogroup(candidates).applyInArrow(lambda q, c: tiles(q, c, k), _BOUNDED)
    return merge(rescored(above_floor(bounded, k), rows), k)


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query by a heap per query, first over what lies in one partition, then over all of them."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*(column.to_pylist() for column in batch.columns)):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        for query, heap in heaps.items():
            heap.sort(reverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([query] * len(heap)), pa.array([-v for _, v in heap]), pa.array([s for s, _ in heap])],
                names=["query_id", "vec_id", "score"],
            )

    merged = found.mapInArrow(best, _FOUND).repartition("query_id").mapInArrow(best, _FOUND)
    best_of = merged.groupBy("query_id").agg(
        F.expr("array_sort(collect_list(struct(-score as down, vec_id, score)))").alias("best")  # k rows of one query
    )
    return best_of.select("query_id", F.posexplode("best").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )


def op1_block_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_SQL = """
with v as (select vec_id, embedding::double[] as x from embeddings
           where vec_id is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
             and len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.x, c.x) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from pairs qualify rank <= 20
"""

QUERIES: dict[str, tuple[Callable, str | None]] = {"op1_block_search": (op1_block_search, _SQL)}
