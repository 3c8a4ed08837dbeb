"""One pass over a corpus that finds the k best rows for every query.

Queries are cut into blocks small enough to broadcast. For each block the
corpus is scanned once, where it lies: no corpus row is shuffled. Each task
scores Arrow batches against the block with matrix products and keeps k
candidates per query; only these are shuffled, by query, for the final rank.
A hot source, cell or group of copies therefore never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.functions.text import id_order
from orbivec.operators.nearest import Nearest, _as
from orbivec.session import materialise, scratch_path

#: Most queries of one broadcast block, and most bytes of their payload.
BLOCK_QUERIES = 4096
BLOCK_BYTES = 512 * 1024 * 1024
#: A pass costs time of its own: full blocks of short vectors grow to this many queries, of no more bytes than this.
PASS_QUERIES, PASS_BYTES = 4 * BLOCK_QUERIES, 32 * 1024 * 1024

#: More rows than a query can have: lists bounded by their limits alone.
EVERY = 2**40

_TIE = "__tie"
_CELLS = 4_000_000  # distances computed at a time inside a task
_TILE_CELLS = 262_144  # and where passes over them matter: as many as a core's cache holds
_TILE_ROWS = 512  # rows of a batch compared at a time: bounds fall between them
_PAIR_CELLS = 16_384  # vector elements gathered at a time when pairs are scored: they stay in a core's cache
_SINGLE_RANGE = 1e30  # largest product single precision is trusted with


@dataclass
class QueryBlock:
    """What every task of one pass needs to know about its queries."""

    ids: pa.Array
    data: dict = field(default_factory=dict)
    limits: np.ndarray | None = None
    shared: list[Broadcast] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.ids)

    def share(self, spark) -> Broadcast:
        """The block as a broadcast, which :meth:`release` ends."""
        shared = spark.sparkContext.broadcast(self)
        self.shared.append(shared)
        return shared

    def release(self) -> None:
        """Give back the memory of its broadcasts, on the driver as well; what reads them must have run."""
        while self.shared:
            self.shared.pop().destroy()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": []}


def query_blocks(queries: DataFrame, id_col: str, columns: list[str], weight: Column,
                 block_queries: int = BLOCK_QUERIES, together: bool = False, grow: bool = False):
    """Cut a query table into Arrow tables of at most ``block_queries`` rows and ``BLOCK_BYTES`` bytes.

    With ``grow``, blocks of ``BLOCK_QUERIES`` rows or more grow to ``PASS_QUERIES`` where these have no more than ``PASS_BYTES``.

    Count and size (``weight`` is bytes per row) are known before anything is
    collected. A table that fits is one block. A larger one is written once
    below the shared folder and read back block by block, a block being the
    ids of one hash bucket, so the driver never holds more than one block.
    ``together`` puts small blocks together, up to ``BLOCK_QUERIES`` and ``BLOCK_BYTES``.
    """
    sized = queries.select(id_col, *[c for c in columns if c != id_col], weight.cast("bigint").alias("__weight"))
    rows, size = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    if grow and block_queries >= BLOCK_QUERIES:
        block_queries = max(block_queries, min(PASS_QUERIES, PASS_BYTES * rows // max(size, 1)))
    if rows <= block_queries and size <= BLOCK_BYTES:
        yield _checked(sized.drop("__weight").toArrow(), id_col)
        return
    kept = materialise(sized, "queries")
    parts = max(-(-10 * rows // (9 * block_queries)), -(-10 * size // (9 * BLOCK_BYTES)))
    for _ in range(12):
        block = F.pmod(F.xxhash64(id_col), F.lit(parts))
        buckets = kept.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("__weight").alias("w"))
        if buckets.filter((F.col("n") > block_queries) | ((F.col("w") > BLOCK_BYTES) & (F.col("n") > 1))).isEmpty():
            break
        parts = parts * 3 // 2 + 1
    else:
        raise ValueError("too many queries share an id: query ids must be unique")
    for lo, hi in _groups(buckets, parts) if together else zip(range(parts), range(parts)):
        rows = kept.filter(block.between(lo, hi)).drop("__weight").toArrow()
        if rows.num_rows:
            yield _checked(rows, id_col)


def _groups(buckets: DataFrame, parts: int):
    """First and last number of neighbouring buckets that fit one block together; one row per bucket is collected."""
    sizes = {r.b: (r.n, r.w) for r in buckets.collect()}
    lo, rows, size = 0, 0, 0
    for number in range(parts):
        n, w = sizes.get(number, (0, 0))
        if number > lo and (rows + n > BLOCK_QUERIES or size + w > BLOCK_BYTES):
            yield lo, number - 1
            lo, rows, size = number, 0, 0
        rows, size = rows + n, size + w
    yield lo, parts - 1


def _checked(rows: pa.Table, id_col: str) -> pa.Table:
    ids = rows.column(id_col)
    if len(ids.unique()) != len(ids):
        raise ValueError("query ids must be unique")
    return rows


def matrix(column, dtype=np.float64) -> np.ndarray:
    """Arrow list column of equal lengths, without NULLs, as a 2-d array; ``dtype`` None keeps the stored type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0), dtype or np.float64)
    flat = column.flatten()
    if len(flat) % rows or not _equal_lengths(column, len(flat) // rows):
        raise ValueError("vectors of different lengths; pass the table through gate() first")
    flat = flat.to_numpy(zero_copy_only=False)
    return (flat if dtype is None else flat.astype(dtype, copy=False)).reshape(rows, -1)


def _equal_lengths(column: pa.Array, dim: int) -> bool:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return bool((lengths == dim).all())


def chunks(n: int, width: int, cells: int = _CELLS):
    """Index ranges of ``n`` queries so that one block of ``width`` rows has at most ``cells`` distances."""
    step = max(1, cells // max(width, 1))
    for lo in range(0, n, step):
        yield np.arange(lo, min(lo + step, n))


def tiles(n: int, rows: int, limits: np.ndarray, k: int = 1):
    """Some of ``n`` queries and a slice of ``rows`` rows at a time, all queries before the next rows.

    While no query has a limit, the first slice is long enough for its ``k`` best to rule out most others.
    """
    first = _TILE_ROWS if np.isfinite(limits).any() else min(max(_TILE_ROWS, 64 * k), 16 * _TILE_ROWS)
    for lo in [0, *range(first, rows, _TILE_ROWS)]:
        at = slice(lo, min(lo + (_TILE_ROWS if lo else first), rows))
        for part in chunks(n, at.stop - lo, _TILE_CELLS):
            yield part, at


@dataclass
class Scored:
    """Distances of some queries (rows of ``block``) to some rows of a batch (its columns).

    They may be off by up to ``margin`` per query; ``exact`` then gives the
    distances of chosen (query index, row index) pairs.
    """

    queries: np.ndarray
    rows: np.ndarray
    block: np.ndarray
    detail: np.ndarray | None = None
    margin: np.ndarray | None = None
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


# A scorer is called once per task with the block's data and returns a function
# (batch, current bound of every query) -> iterator of Scored.
Scorer = Callable[[dict], Callable]


def scan_block(corpus: DataFrame, block: QueryBlock, scorer: Scorer, k: int, *, inputs: list[str],
               id_col: str = "_id", carry: list[str] = (), query_type: T.DataType | None = None,
               decimals: int = 9, detail: str | None = None) -> DataFrame:
    """k best candidates *per task* for one block: ``(query_id, id, carry..., tie, distance[, detail])``."""
    spark = corpus.sparkSession
    id_type = corpus.schema[id_col].dataType
    tie = F.col(id_col).cast("bigint") if isinstance(id_type, T.IntegralType) else id_order(F.col(id_col))
    source = corpus.select(id_col, *carry, tie.alias(_TIE), *inputs)
    for name in inputs:
        source = source.filter(F.col(name).isNotNull())
    if not len(block):
        source = source.filter(F.lit(False))
    out = [T.StructField("query_id", query_type), *[source.schema[c] for c in (id_col, *carry)],
           T.StructField(_TIE, T.LongType()), T.StructField("distance", T.DoubleType())]
    if detail:
        out.append(T.StructField(detail, T.IntegerType()))
    shared = block.share(spark)
    keep = [id_col, *carry]

    def run(batches):
        mine = shared.value
        blocks_of = scorer(mine.data | {"k": k})
        best = Nearest(len(mine), k, mine.limits, decimals)

        def emit():
            for q, d, ties, payload, extra in best.drain():
                columns = [mine.ids.take(pa.array(q)), *payload.columns, pa.array(ties), pa.array(d)]
                names = ["query_id", *payload.schema.names, _TIE, "distance"]
                if detail:
                    columns.append(pa.array(extra.astype(np.int32)))
                    names.append(detail)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ties = batch.column(_TIE).to_numpy(zero_copy_only=False)
            payload = batch.select(keep)
            for scored in blocks_of(batch, best.limits):
                best.offer(scored, ties, payload)
                if best.overfull():
                    yield from emit()
        yield from emit()

    return source.mapInArrow(run, T.StructType(out))


_BIN_BITS = 44  # low bits of a distance that one bin of a histogram spans: 256 bins per power of two


def _bins(d: np.ndarray) -> np.ndarray:
    """Numbers of the bins of distances, in their order."""
    bits = (d + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))) >> _BIN_BITS


def _upper_edge(bins: np.ndarray) -> np.ndarray:
    """A distance that no distance of the bin exceeds."""
    bits = ((bins + 1) << _BIN_BITS) - 1
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)


class _Tally:
    """How many rows each query has in each bin of distances; limits fall where a query has ``cap`` rows."""

    _SHIFT, _ZERO = 20, np.int64(1 << 19)  # numbers of bins have 20 bits, signed

    def __init__(self, limits: np.ndarray, cap: int):
        self.limits, self.cap = limits.astype(np.float64).copy(), cap
        self.keys, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, scored: Scored, slack: float) -> None:
        off = np.full(len(scored.queries), slack) if scored.margin is None else slack + scored.margin
        block, limits = scored.block, self.limits[scored.queries]
        keep = block <= _as(limits + off, block)[:, None]
        if block.shape[1] > self.cap and np.count_nonzero(keep) > 2 * self.cap * len(limits):
            # The block's own cap-th distance is a limit as well.
            kth = np.partition(block, self.cap - 1, axis=1)[:, self.cap - 1].astype(np.float64) + off
            there = np.isfinite(kth)
            limits[there] = np.fmin(limits[there], _upper_edge(_bins(kth[there])))
            self.limits[scored.queries] = limits
            keep = block <= _as(limits + off, block)[:, None]
        q, r = np.divmod(np.flatnonzero(keep), block.shape[1])
        d = block[q, r].astype(np.float64) + off[q]  # the true distance is no larger
        whole = np.isfinite(d)
        found = np.unique((scored.queries[q[whole]] << self._SHIFT) | (_bins(d[whole]) + self._ZERO), return_counts=True)
        self.parts.append(found)
        self.pending += len(found[0])
        if self.pending > max(len(self.keys), 1_000_000):
            self.compact()

    def compact(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        times = np.concatenate([self.times, *(n for _, n in self.parts)])
        self.parts, self.pending = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, starts = np.unique(keys[order], return_index=True)
        times = np.add.reduceat(times[order], starts)
        q = keys >> self._SHIFT
        upto, first = np.cumsum(times), np.searchsorted(q, q)
        before = upto - times
        full = upto - before[first] >= self.cap
        cut = full & (before - before[first] < self.cap)  # one bin of each query that has enough
        self.limits[q[cut]] = np.fmin(self.limits[q[cut]], _upper_edge(self.bins(keys[cut])))
        kept = ~full | cut
        self.keys, self.times = keys[kept], times[kept]

    def bins(self, keys: np.ndarray) -> np.ndarray:
        return (keys & ((1 << self._SHIFT) - 1)) - self._ZERO


def cut_at(corpus: DataFrame, block: QueryBlock, scorer: Scorer, cap: int, *, inputs: list[str]) -> np.ndarray:
    """Limits of a block's queries that at least ``cap`` rows keep, or the given ones where fewer are within them.

    One pass counts the rows within the limits in bins of their distances, a
    counter per task, query and bin in use; Spark adds them up, and one number
    per query comes back. A task that has ``cap`` rows of a query looks no
    further than their bins. A second pass with these limits hands on no more
    than ``cap`` rows and one bin per query, over all tasks.
    """
    spark = corpus.sparkSession
    source = corpus.select(*inputs)
    for name in inputs:
        source = source.filter(F.col(name).isNotNull())
    shared = spark.sparkContext.broadcast(block)

    def count(batches):
        mine = shared.value
        blocks_of = scorer(mine.data)
        tally = _Tally(mine.limits, cap)
        for batch in batches:
            if batch.num_rows:
                for scored in blocks_of(batch, tally.limits):
                    tally.add(scored, 1e-8)
        tally.compact()
        yield pa.RecordBatch.from_arrays([pa.array(tally.keys >> tally._SHIFT), pa.array(tally.bins(tally.keys)), pa.array(tally.times)],
                                         names=["query", "bin", "n"])

    counted = source.mapInArrow(count, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy("bin")))
    cuts = upto.filter(F.col("upto") >= cap).groupBy("query").agg(F.min("bin").alias("bin")).toArrow()
    limits = block.limits.astype(np.float64).copy()
    at = cuts.column("query").to_numpy()
    limits[at] = np.fmin(limits[at], _upper_edge(cuts.column("bin").to_numpy()))
    shared.destroy()
    return limits


def merge_salts(corpus: DataFrame) -> int:
    """Fan-in of the two-step merge, read from the cluster's own shuffle width."""
    return 64 if int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 64 else 1


def merge(candidates: DataFrame, k: int, id_col: str = "_id", salts: int = 1) -> DataFrame:
    """Rank candidates per query and keep k; adds ``rank``.

    With ``salts`` above 1 the candidates of one query are first cut to k in
    that many groups, so no single task sorts what all corpus tasks emitted.
    """
    order = [F.col("distance"), F.col(_TIE), F.col(id_col)]
    if salts > 1:
        salted = candidates.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        within = Window.partitionBy("query_id", "__salt").orderBy(*order)
        candidates = (salted.withColumn("__place", F.row_number().over(within))
                      .filter(F.col("__place") <= k).drop("__place", "__salt"))
    ranked = Window.partitionBy("query_id").orderBy(*order)
    return (candidates.withColumn("rank", F.row_number().over(ranked))
            .filter(F.col("rank") <= k).drop(_TIE))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_turn(parts: Iterator[tuple[QueryBlock, DataFrame]], k: int, id_col: str = "_id", salts: int = 1) -> DataFrame:
    """:func:`merge` of the candidates of each block.

    Those of one block stay a plan. Several blocks run one after the other: the hits of each are written below the
    shared folder and its broadcasts released before the next one is read, so neither the driver's memory nor any plan
    grows with their number.
    """
    first, second = next(parts), next(parts, None)
    if second is None:
        return merge(first[1], k, id_col, salts)
    spark = first[1].sparkSession
    path = scratch_path(spark, "hits")
    for block, candidates in chain([first, second], parts):
        hits = merge(candidates, k, id_col, salts)
        hits.write.mode("append").parquet(path)
        block.release()
    return spark.read.schema(hits.schema).parquet(path)


# --- dense vectors ---------------------------------------------------------


def dense_distances(q: np.ndarray, x: np.ndarray, space: str) -> np.ndarray:
    """Distances of every query row to every corpus row, in double precision."""
    products = q @ x.T
    if space == "innerproduct":
        return -products
    if space == "l2":
        products *= -2.0
        products += np.einsum("ij,ij->i", q, q)[:, None]
        products += np.einsum("ij,ij->i", x, x)[None, :]
        return np.maximum(products, 0.0, out=products)
    lengths = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * np.sqrt(np.einsum("ij,ij->i", x, x))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - np.where(lengths > 0, products / lengths, np.nan)


class Rows:
    """Vectors of one batch, in the precisions and with the lengths scoring needs."""

    def __init__(self, stored: np.ndarray, space: str):
        self.stored, self.space = stored, space

    def __len__(self) -> int:
        return len(self.stored)

    @cached_property
    def double(self) -> np.ndarray:
        return self.stored.astype(np.float64, copy=False)

    @cached_property
    def single(self) -> np.ndarray:
        """What :attr:`Dense.single` is multiplied with: the product is the distance, without further passes over it."""
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if self.space == "l2":
                return _beside(self.stored, 1.0, self.squares)
            if self.space == "cosine":
                return _beside(self.double / np.sqrt(self.squares)[:, None], 1.0)
            return self.stored.astype(np.float32, copy=False)

    @cached_property
    def squares(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.double, self.double)

    @cached_property
    def malformed(self) -> np.ndarray | None:
        """Which rows hold NULL, NaN or infinite elements, or None."""
        spoilt = ~np.isfinite(self.squares)
        return spoilt if spoilt.any() else None

    @cached_property
    def longest(self) -> float:
        """Length of the longest well-formed vector; malformed ones say nothing about the others."""
        return float(np.sqrt(self.squares[np.isfinite(self.squares)].max(initial=0.0)))


def _beside(x: np.ndarray, *columns) -> np.ndarray:
    """A matrix with further columns, in single precision."""
    out = np.empty((len(x), x.shape[1] + len(columns)), np.float32)
    out[:, :x.shape[1]] = x
    for i, c in enumerate(columns):
        out[:, x.shape[1] + i] = c
    return out


class Dense:
    """Distances of a block of queries to batches of rows.

    Once every query of a part has a bound, a single-precision product finds
    the few rows that can still matter; its rounding error is bounded by
    ``margin``, and those rows are scored again in double precision. Hits and
    distances are the same as without this step.
    """

    def __init__(self, vectors: np.ndarray, space: str):
        self.space, self.double = space, vectors
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.lengths = np.sqrt(self.squares)
        self._space = np.empty(0, np.float32)

    @cached_property
    def single(self) -> np.ndarray:
        """Queries whose products with :attr:`Rows.single` are the distances."""
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if self.space == "l2":
                return _beside(-2 * self.double, self.squares, 1.0)
            if self.space == "cosine":
                return _beside(-self.double / self.lengths[:, None], 1.0)
            return (-self.double).astype(np.float32)

    @property
    def asking(self) -> np.ndarray:
        """Queries that can have hits; the others would never get a bound, and hold back those scored with them."""
        there = np.isfinite(self.double).all(axis=1)
        return np.flatnonzero(there & (self.lengths > 0) if self.space == "cosine" else there)

    def _room(self, cells: int) -> np.ndarray:
        """Memory for a block, the same for each: a new one costs as much time in page faults as the product itself."""
        if cells > len(self._space):
            self._space = np.empty(max(cells, _TILE_CELLS), np.float32)
        return self._space[:cells]

    def rows(self, stored: np.ndarray) -> Rows:
        if len(stored) and stored.shape[1] != self.double.shape[1]:
            raise ValueError(f"query dimension {self.double.shape[1]} differs from corpus dimension {stored.shape[1]}")
        return Rows(stored, self.space)

    def scored(self, part: np.ndarray, x: Rows, limits: np.ndarray, at: np.ndarray | slice | None = None) -> Scored:
        """Queries ``part`` against all rows of the batch, or those at ``at``; the block is valid until the next call."""
        at = slice(None) if at is None else at
        span = (self.lengths[part] + x.longest) ** 2
        rough = bool(np.isfinite(limits[part]).all() and span.max(initial=0.0) < _SINGLE_RANGE)
        unit = 2.0**-24 if rough else 2.0**-53
        reach = self.lengths[part] * x.longest
        margin = {"l2": span, "innerproduct": reach}.get(self.space, 2.0) * np.full(len(part), (self.double.shape[1] + 24) * unit)
        if rough:
            q, v = self.single[part], x.single[at]
            block = np.matmul(q, v.T, out=self._room(len(q) * len(v)).reshape(len(q), len(v)))
        else:
            squares = x.squares[at]
            block = self.double[part] @ x.double[at].T
            if self.space == "innerproduct":
                np.negative(block, out=block)
            elif self.space == "l2":
                block *= -2
                block += self.squares[part][:, None]
                block += squares[None, :]
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    block *= (1.0 / self.lengths[part])[:, None]
                    block *= (1.0 / np.sqrt(squares))[None, :]
                np.subtract(1, block, out=block)
        if x.malformed is not None:
            block[:, x.malformed[at]] = np.inf  # never a hit, and never part of a bound
        return Scored(part, np.arange(len(x))[at], block, None, margin, lambda qi, ri: self.exact(qi, ri, x))

    def exact(self, qi: np.ndarray, ri: np.ndarray, x: Rows) -> np.ndarray:
        """Double-precision distances of pairs; a pair's value never depends on what is scored with it."""
        out = np.empty(len(qi))
        step = max(1, _PAIR_CELLS // max(self.double.shape[1], 1))
        for lo in range(0, len(qi), step):
            q, v = self.double[qi[lo:lo + step]], x.stored[ri[lo:lo + step]].astype(np.float64)
            if self.space == "l2":
                q -= v
                out[lo:lo + step] = np.einsum("ij,ij->i", q, q)
            else:
                out[lo:lo + step] = np.einsum("ij,ij->i", q, v)
        if self.space == "innerproduct":
            return -out
        if self.space == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                return 1.0 - out / (self.lengths[qi] * np.sqrt(x.squares[ri]))
        return out


def stored_matrix(column) -> np.ndarray:
    return matrix(column, None)


def dense_scorer(space: str, vector_col: str, read=stored_matrix) -> Scorer:
    def prepare(data):
        near = Dense(data["vectors"], space)
        asking = near.asking

        def blocks(batch, limits):
            x = near.rows(read(batch.column(vector_col)))
            for part, at in tiles(len(asking), len(x), limits, data.get("k", 1)):
                yield near.scored(asking[part], x, limits, at)

        return blocks

    return prepare


def nested_scorer(space: str, outer: str, inner: str) -> Scorer:
    """Parents scored by their closest child; the child's position is the detail. NULL children are skipped."""

    def prepare(data):
        q = data["vectors"]

        def blocks(batch, limits):
            lists = batch.column(outer)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            rows = np.flatnonzero(counts > 0)
            if not len(rows):
                return
            structs = lists.flatten()
            children = structs.flatten()[structs.type.get_field_index(inner)]  # a NULL struct has a NULL vector
            there = children.is_valid().to_numpy(zero_copy_only=False)
            if not there.any():
                return
            x = matrix(children.drop_null())
            place = np.concatenate([np.arange(n) for n in counts[rows]])[there]
            rows, starts, counts = np.unique(np.repeat(rows, counts[rows])[there], return_index=True, return_counts=True)
            ends = np.cumsum(counts)
            for group in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends // _TILE_ROWS)) + 1):  # whole parents
                lo, hi = starts[group[0]], ends[group[-1]]
                for part in chunks(len(q), hi - lo, _TILE_CELLS):
                    d = dense_distances(q[part], x[lo:hi], space)
                    d = np.where(np.isnan(d), np.inf, d)
                    best = np.minimum.reduceat(d, starts[group] - lo, axis=1)
                    at_best = d == np.repeat(best, counts[group], axis=1)
                    child = np.minimum.reduceat(np.where(at_best, place[lo:hi], np.iinfo(np.int64).max), starts[group] - lo, axis=1)
                    yield Scored(part, rows[group], best, child)

        return blocks

    return prepare
