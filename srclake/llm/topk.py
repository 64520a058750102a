"""Exact top-k by inner product: an impact-ordered index, read score at a time.

The index cuts the vectors into blocks. In a block every component has posting segments: the vectors whose value falls in
one quantisation step, steps from one end to the other. For a query, a component's segments are taken from the end that
suits the sign of its weight; counted from the other end of the component's range every contribution is at least zero, so a
partial sum is a lower bound, and the sum of what each component's next segment can add bounds the rest. Segments are
processed by descending quantised impact. Reading stops when the bounds prove that all but a few vectors are out (or all
segments are read); those few are scored exactly from their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclake.llm.common import materialise

#: Components in a block of the index and in one of queries, quantisation steps of a component, and rounds after each of
#: which the bounds are looked at.
BLOCK, QUERIES, STEPS, ROUNDS = 1 << 20, 1 << 18, 32, 8
#: A block is read until at most this many times k vectors can be members.
FEW = 8
#: Bytes of queries that a task holds beside the index.
HELD = 32 << 20


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long, the nearest long where it is beyond; null for vectors that are null, empty,
    or hold nulls or non-finite ones."""
    x = vector.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


class Block:
    """One block of the index: ids, components, and each component's postings in order of their quantised values."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        dims = values.shape[1]
        self.wide = float(np.abs(values.astype(float)).max()) * dims * 4
        if self.wide >= 2.0**61:
            return  # no bounds: every query is scored in full
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.width = (self.high - self.low) // STEPS + 1
        columns = np.ascontiguousarray(values.T)
        step = ((columns - self.low[:, None]) // self.width[:, None]).astype(np.int16)
        self.order = np.argsort(step, axis=1, kind="stable").astype(np.int32)
        self.posted = np.take_along_axis(columns, self.order, axis=1)
        step = np.take_along_axis(step, self.order, axis=1)
        self.edge = np.stack([np.searchsorted(step[d], np.arange(STEPS + 1)) for d in range(dims)])

    def top_wide(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with integers of any size, for products that a long cannot hold."""
        score = (self.values.astype(object) * query.astype(object)).sum(axis=1)
        score = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in score], np.int64)
        first = np.lexsort((self.ids, ~score))  # ~ reverses the order and, unlike the minus sign, has no exception
        first = first[~np.isin(first, own)][:k]
        return self.ids[first], score[first]

    def top(self, query: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the query's first k in this block, without vector `skip`."""
        own = np.nonzero(self.ids == skip)[0]
        if self.wide * float(np.abs(query.astype(float)).max()) >= 2.0**61:
            return self.top_wide(query, k, own)
        n, dims = self.values.shape
        up, s = query > 0, np.arange(STEPS)
        # The most that a vector of a segment adds over the component's worst value; segments from the good end.
        best = np.where(
            up[:, None],
            np.minimum(self.low[:, None] + (STEPS - s) * self.width[:, None] - 1, self.high[:, None]) - self.low[:, None],
            self.high[:, None] - (self.low[:, None] + s * self.width[:, None]),
        )
        best = np.append(np.maximum(best, 0) * np.abs(query)[:, None], np.zeros((dims, 1), np.int64), axis=1)
        worst = np.where(up, self.low, self.high)
        # Impacts fall along a component, so a bar on the impact gives each component a number of segments to read.
        bars = np.quantile(best[:, :-1], 1 - np.arange(1, ROUNDS + 1) / ROUNDS, method="lower")
        partial, read, want = np.zeros(n, np.int64), np.zeros(dims, np.int64), k + len(own)  # as many of the first may be the query's own rows
        maybe = np.arange(n)
        for bar in bars:
            upto = (best[:, :-1] >= max(bar, 1)).sum(axis=1)
            for d in np.nonzero(upto > read)[0]:
                a, b = (STEPS - upto[d], STEPS - read[d]) if up[d] else (read[d], upto[d])
                a, b = self.edge[d, a], self.edge[d, b]
                partial[self.order[d, a:b]] += (self.posted[d, a:b] - worst[d]) * query[d]
            read = np.maximum(read, upto)
            rest = best[np.arange(dims), read].sum()
            if n > want:
                maybe = np.nonzero(partial + rest >= np.partition(partial, n - want)[n - want])[0]
            if len(maybe) <= FEW * k + len(own):
                break  # proven: every other vector's upper bound is under k lower bounds of others
        maybe = maybe[self.ids[maybe] != skip]
        score = self.values[maybe] @ query
        first = np.lexsort((self.ids[maybe], -score))[:k]
        return self.ids[maybe][first], score[first]


def _packed(values: np.ndarray) -> bytes:
    """The integers in as few bytes each as hold all of them."""
    low, high = int(values.min()), int(values.max())
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * dims)}").reshape(n, dims).astype(np.int64)


def _build(most: int):
    """Blocks of vectors of one length each, from (ids..., v): what identifies them and their components, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def flush(dims: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dims)))
            count.pop(dims)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((dims, pa.int32()), (ids.tobytes(), pa.binary()), (_packed(values), pa.binary()))], ["dims", "ids", "vectors"])

        for b in batches:
            ids = np.stack([b.column(i).to_numpy() for i in range(b.num_columns - 1)], axis=1)
            lists = b.column(b.num_columns - 1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            start = np.concatenate(([0], np.cumsum(sizes)))
            for dims in np.unique(sizes).tolist():
                own = np.nonzero(sizes == dims)[0]
                rows = max(256, most // max(dims, 1))
                for a in range(0, len(own), rows):
                    some = own[a : a + rows]
                    held.setdefault(dims, []).append((ids[some], flat[start[some][:, None] + np.arange(dims)]))
                    count[dims] = count.get(dims, 0) + len(some)
                    if count[dims] >= rows:
                        yield flush(dims)
        for dims in list(held):
            yield flush(dims)

    return run


def _search(k: int):
    """Rows (dims, s, t, in_index, ids, vectors) are sorted: the blocks of queries of a cell come first and are held, then
    each of its index blocks is built and answers them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for dims, s, t, in_index, ids, vectors in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (dims, s, t) != last:
                    last, held = (dims, s, t), []
                if not in_index:
                    held.append((np.frombuffer(ids, np.int64).reshape(-1, 2), vectors))
                    continue
                ids = np.frombuffer(ids, np.int64)
                block = Block(ids, _unpacked(vectors, len(ids), dims)) if held else None
                for asked, wanted in held:
                    out = []
                    for (row, query), vector in zip(asked.tolist(), _unpacked(wanted, len(asked), dims)):
                        who, score = block.top(vector, k, query)
                        out.append((np.full(len(who), row), np.full(len(who), query), who, score))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): for each row of queries(vec_id, v array<long>) the k rows of
    vectors(vec_id, v) with the largest inner product, ties to the smaller vec_id, all if fewer; rows with the query's own
    vec_id take no part.

    Rows whose v or vec_id is null or empty are left out; only vectors of the query's length can be found. Repeated rows of
    vectors are found each for itself, and repeated queries answered once for each different vector. Products are exact; a
    score beyond the range of a long is the nearest long, and ties with others there. Other columns are ignored; empty tables
    give an empty result.

    Blocks of queries meet blocks of the index in cells (dims, s, t): s deals the index to as many cells as tasks, t cuts the
    queries into parts of HELD bytes or so. A block of the index goes to all parts of the queries and one of queries to all of
    the index, by one shuffle and without a broadcast, so neither the driver nor a task holds more with more queries. Each pair
    of blocks gives its k best of a query.
    """
    clean = lambda df: df.where("vec_id is not null and size(v) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    blocks = lambda df, most, what: materialise(df.mapInArrow(_build(most), "dims int, ids binary, vectors binary").select(F.monotonically_increasing_id().alias("block"), "*"), what)
    index = blocks(clean(vectors), BLOCK, "index")
    asked = blocks(clean(queries).distinct().select(F.monotonically_increasing_id().alias("row"), "*"), QUERIES, "queries")
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, min(spread, index.count()))
    parts = 1 + (asked.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0) // HELD
    place = lambda n: F.pmod(F.col("block") + F.shiftrightunsigned("block", 33), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = lambda df, s, t, in_index: df.select("dims", s.alias("s"), t.alias("t"), F.lit(in_index).alias("in_index"), "ids", "vectors")
    both = cells(asked, every(across), place(parts), False).unionAll(cells(index, place(across), every(parts), True))
    # A cell has few bytes and much work: a given number of tasks, so that cells are not put together, and more than there are cells.
    both = both.repartition(max(spread, 4 * across * parts), "dims", "s", "t").sortWithinPartitions("dims", "s", "t", "in_index")
    found = both.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
