"""Exact top-k by inner product: no-random-access aggregation of sorted lists.

Vectors become whole numbers, floor(scale * x). They are dealt into blocks whose size is
bounded by ``BLOCK_ENTRIES`` list entries, by a hash of their row, so that neither an id nor
equal vectors can make a block large. In a block every dimension is a list sorted by value.

A query is a weighted sum over these lists. All lists are read in step, from both ends (a
negative weight asks for small values first). What has been read of a vector is known; what
has not lies between the two frontiers of its list. This gives each candidate a lower and an
upper bound. A candidate whose upper bound is under the k-th largest lower bound is an
outsider. Reading stops when few others are left, or at the lists' middle, where all is
known; then the rest is resolved to final scores. Depth is the same for all lists, so the
bounds of a batch of queries are two matrix products over the values read and the frontiers.

Queries are a stated part of the rows. Each is sent once to every block: its rows stream
through the task that holds the block. A block answers with its k best, and Spark ranks them.

Defined results: vectors that are NULL or hold NULL, infinite or NaN components, or one whose
whole number is 2^24 or more, take no part; shorter vectors are continued with zeros (an
empty one scores 0); repeated rows are candidates each, and queries each, and only a query's
own row is left out for it; of equal scores the smaller id comes first, NULL ids last; rows
with NULL ids are never queries; fewer candidates than k give fewer rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posture.llm.common import durable, ship, table

SCALE = 256
TOP = 5
QUERY_EVERY = 50
#: Entries of all sorted lists of a block: 8,192 rows of 64 dimensions.
BLOCK_ENTRIES = 1 << 19
#: Components from here on take no part: their products might not fit into a long.
LARGEST = 1 << 24
#: Shares of a list that are read from either end before bounds are compared.
DEPTHS = (0.25, 0.375, 0.4375, 0.5)
#: A query's last candidates are resolved when at most this share of the block is left.
FEW = 0.02
#: Bounds that are held at a time.
BOUNDS = 1 << 21

FOUND_SCHEMA = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


class Lists:
    """Sorted lists of a block's dimensions, and what is known when they are read to a depth."""

    def __init__(self, values: np.ndarray, kind: type):
        self.values = values.astype(kind)
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        self.low, self.high = np.empty_like(self.values), np.empty_like(self.values)
        self.read = 0
        self.bounds: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest value that each entry can have at a depth."""
        if depth not in self.bounds:
            n = len(self.values)
            until = n - n // 2 if depth >= 0.5 else int(n * depth)
            for rows in (slice(self.read, until), slice(n - until, n - self.read)):
                seen, value = self.order[rows], self.sorted[rows]
                np.put_along_axis(self.low, seen, value, axis=0)
                np.put_along_axis(self.high, seen, value, axis=0)
            self.read = until
            middle = self.order[until : n - until]
            if len(middle):
                # What is not read yet lies between the frontiers of its list.
                np.put_along_axis(self.low, middle, self.sorted[until], axis=0)
                np.put_along_axis(self.high, middle, self.sorted[n - until - 1], axis=0)
            self.bounds[depth] = self.low.copy(), self.high.copy()
        return self.bounds[depth]


def _kind(dimensions: int, largest: int) -> type:
    """Numbers in which sums of products are exact; the narrowest are the fastest."""
    most = dimensions * max(1, largest) ** 2
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Block:
    def __init__(self, ids: list[int | None], rows: np.ndarray, values: np.ndarray):
        # Sorted by id, so that a smaller index wins a tie.
        order = np.array(
            sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), dtype=np.int64
        )
        self.ids, self.rows = [ids[i] for i in order.tolist()], rows[order]
        self.values = values[order]
        self.largest = int(np.abs(values).max(initial=0))
        self.lists: dict[type, Lists] = {}

    def best(self, queries: np.ndarray, own: np.ndarray, top: int) -> list[tuple]:
        """(query, candidate, score): the ``top`` best candidates of each query."""
        n, found = len(self.ids), []
        kind = _kind(queries.shape[1], max(self.largest, int(np.abs(queries).max(initial=0))))
        if kind not in self.lists:
            self.lists[kind] = Lists(self.values, kind)
        lists = self.lists[kind]
        lowest = np.iinfo(kind).min if kind is np.int64 else -np.inf
        at = {row: i for i, row in enumerate(self.rows.tolist())}
        mine = [at.get(row) for row in own.tolist()]
        step = max(1, BOUNDS // n)
        for begin in range(0, len(queries), step):
            open_ = np.arange(begin, min(begin + step, len(queries)))
            for depth in DEPTHS:
                low, high = lists.at(depth)
                part = queries[open_].astype(kind)
                up, down = np.maximum(part, 0), np.minimum(part, 0)
                least = up @ low.T + down @ high.T
                most = up @ high.T + down @ low.T
                for i, query in enumerate(open_.tolist()):
                    if mine[query] is not None:  # its own row is no candidate
                        least[i, mine[query]] = most[i, mine[query]] = lowest
                place = max(0, n - top)
                bound = np.partition(least, place, axis=1)[:, place]
                inside = most >= bound[:, None]
                left = inside.sum(axis=1)
                done = (left <= max(top + 1, FEW * n)) | (depth == DEPTHS[-1])
                for i in np.flatnonzero(done).tolist():
                    query = int(open_[i])
                    some = np.flatnonzero(inside[i])
                    some = some[some != mine[query]] if mine[query] is not None else some
                    score = lists.values[some] @ queries[query].astype(kind)
                    ranked = np.lexsort((some, -score))[:top]
                    found += [(query, int(some[j]), int(score[j])) for j in ranked]
                open_ = open_[~done]
                if not len(open_):
                    break
        return found


def vectors(
    frame: DataFrame, scale: int = SCALE, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(row, vec_id, x): whole numbers of the vectors that take part, shuffled by nothing."""
    whole = F.transform(column, lambda c: F.floor(F.lit(scale) * c.cast("double")))

    def sound(c: Column) -> Column:
        # NaN is larger than all numbers in comparisons.
        fits = F.abs(F.lit(scale) * c.cast("double")) < F.lit(LARGEST)
        return F.coalesce(fits, F.lit(False))

    return frame.filter(F.col(column).isNotNull() & F.forall(column, sound)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("bigint").alias("vec_id"),
        F.transform(whole, lambda c: c.cast("int")).alias("x"),
    )


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(sizes) and (sizes == dimensions).all():
        return flat.reshape(len(sizes), dimensions).astype(np.int64)
    out = np.zeros((len(sizes), dimensions), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(
    candidates: DataFrame, is_query: Column, top: int = TOP, block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score) from the rows of ``vectors``."""
    spark = candidates.sparkSession
    ship(spark)
    rows = durable(candidates.withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    dimensions = max(1, size["d"] or 0)
    blocks = max(1, -(-size["n"] * dimensions // block_entries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []
        block = None
        for batch in batches:
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            n_held = int(np.searchsorted(asked, True))
            if n_held:
                gathered.append(batch.slice(0, n_held))
            if n_held == batch.num_rows or not gathered:
                continue
            if block is None:
                block = Block(
                    [i for part in gathered for i in part.column("vec_id").to_pylist()],
                    np.concatenate([part.column("row").to_numpy() for part in gathered]),
                    np.concatenate([_matrix(part.column("x"), dimensions) for part in gathered]),
                )
            queries = batch.slice(n_held)
            own = queries.column("row").to_numpy()
            found = block.best(_matrix(queries.column("x"), dimensions), own, top)
            at = pa.array([q for q, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    queries.column("row").take(at),
                    queries.column("vec_id").take(at),
                    pa.array([block.ids[i] for _, i, _ in found], pa.int64()),
                    pa.array([score for *_, score in found], pa.int64()),
                ],
                names=["query_row", "query_id", "vec_id", "score"],
            )

    own_block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    held = rows.select("row", "vec_id", "x", F.lit(False).alias("asked"), own_block.alias("block"))
    asked = rows.filter("is_query").select(
        "row", "vec_id", "x", F.lit(True).alias("asked"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    # A partition is one block: its rows first, then the queries stream by.
    dealt = held.unionByName(asked).repartitionById(blocks, F.col("block"))
    found = dealt.sortWithinPartitions("asked").mapInArrow(search, FOUND_SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= top)
        .select("query_row", "query_id", "rank", "vec_id", "score")
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    found = top_k(rows, F.col("vec_id") % QUERY_EVERY == 0)
    return found.select("query_id", "rank", "vec_id", "score")


OP12_SQL = f"""
WITH whole AS (
    SELECT row_number() OVER () AS place, CAST(vec_id AS BIGINT) AS vec_id,
           list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(
        embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0
),
scored AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.place <> c.place
    WHERE q.vec_id % {QUERY_EVERY} = 0
),
ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank
    FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
