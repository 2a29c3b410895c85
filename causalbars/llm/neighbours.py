"""Approximate nearest neighbours: stable projections to a few dimensions, indexed by kd-trees.

Vectors are scaled to length 1, so that the nearest by cosine are the nearest by distance, and projected to ``dims``
dimensions by Gaussian directions. Squared projected distances are then chi-square distributed about squared true
distances. The upper levels of the kd-tree, fitted on at most ``SAMPLE`` vectors, deal every vector to a cell; each cell
has its own tree below. A query is searched in its own cell first and then in all cells whose projected distance passes
the stopping test against the k-th found there: within a cell leaves come in the order of their least projected
distance and their vectors are verified exactly, until the chi-square test says that, at ``sure``, no vector further
out is nearer than the k-th found.

Queries are joined with cells by a shuffle; none passes through the driver. Cells and queries of a cell beyond a counted
size are split by hash, so that no task holds more. All rows are indexed.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

DIMS, SURE, LEAF, SEED = 10, 0.97, 48, 20240501
#: Vectors that the upper levels are fitted on at most, and cells that they make at most.
SAMPLE, CELLS = 32_768, 4096
#: Bytes of vectors that a cell aims at, and that one task holds at most of a cell's vectors and of its queries.
CELL_BYTES, HELD_BYTES, ASKED_BYTES = 2 << 20, 32 << 20, 8 << 20


def chi_square_quantile(p: float, dims: int) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))
    lo, hi = 0.0, 20.0 * dims
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over projected points; nodes hold their bounding boxes, leaves index ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.kids, self.span = [], [], [], []
        self._build(0, len(points), leaf)
        self.low, self.high = np.asarray(self.low), np.asarray(self.high)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        own, me = self.points[self.order[lo:hi]], len(self.span)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.span.append((lo, hi))
        self.kids.append(None)
        if hi - lo > leaf:
            axis, mid = int(np.argmax(self.high[me] - self.low[me])), (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
            self.kids[me] = (self._build(lo, lo + mid, leaf), self._build(lo + mid, hi, leaf))
        return me

    def leaves(self, q: np.ndarray):
        """(squared projected distance at least, indices) of leaves, nearest first."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        bound = (gap * gap).sum(axis=1)
        heap = [(bound[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.kids[node] is None:
                lo, hi = self.span[node]
                yield d, self.order[lo:hi]
            else:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (bound[kid], kid))


def projected(x: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of length 1 along ``dims`` Gaussian directions, which depend on the vectors' dimensions alone."""
    directions = np.random.default_rng(SEED).standard_normal((x.shape[1], dims))
    x = x / np.abs(x).max(axis=1)[:, None]  # squares of the least and largest numbers stay finite and above 0
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ directions


def search_chunk(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, dims: int = DIMS, sure: float = SURE, known: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query id, vector id, cosine) of the nearest in one chunk of vectors, ties to the smaller id. ``known``: by query,
    the k-th cosine found elsewhere; less is not looked for."""
    length, qlength = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    tree, limit, out = Tree(projected(x, dims)), chi_square_quantile(sure, dims), []
    known = np.full(len(queries), -np.inf) if known is None else known
    for qid, q, ql, at, least in zip(query_ids.tolist(), queries, qlength, projected(queries, dims), known.tolist(), strict=True):
        best: list[tuple[float, int]] = []  # (-cosine, id), nearest first
        for gap, own in tree.leaves(at):
            kth = max(least, -best[-1][0]) if len(best) == k else least
            if gap > limit * (max(0.0, 2 - 2 * kth) + 1e-12):
                break
            cos = (x[own] * q).sum(axis=1) / (length[own] * ql)
            found = ids[own]
            near = (cos >= kth) & (found != qid)
            if near.any():
                best = sorted([*best, *zip((-cos[near]).tolist(), found[near].tolist(), strict=True)])[:k]
        out += [(qid, vid, -d) for d, vid in best]
    return out


def levels(points: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """Upper levels of a kd-tree: nodes (axis, value, kid below, kid from the value on), or (-1, 0, cell, cell)."""
    nodes, cells = [], 0
    todo = [(points, None)]
    while todo:
        own, parent = todo.pop()
        me = len(nodes)
        if parent is not None:
            at, side = parent
            nodes[at] = (*nodes[at][:2], *((me, nodes[at][3]) if side == 0 else (nodes[at][2], me)))
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        value = float(np.median(own[:, axis]))
        below = own[:, axis] < value
        if len(own) <= leaf or not below.any():
            nodes.append((-1, 0.0, cells, cells))
            cells += 1
        else:
            nodes.append((axis, value, -1, -1))
            todo += [(own[below], (me, 0)), (own[~below], (me, 1))]
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    axis, value, low, high = (np.array(x) for x in zip(*nodes, strict=True))
    at = np.zeros(len(points), np.int64)
    while len(open_ := np.flatnonzero(axis[at] >= 0)):
        own = at[open_]
        at[open_] = np.where(points[open_, axis[own]] < value[own], low[own], high[own])
    return low[at]


def _vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: (places, vectors) of a list column."""
    flat, widths = np.asarray(column.flatten(), np.float64), np.asarray(column.value_lengths())
    ends, by = np.cumsum(widths), {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        by[width] = (at, flat[(ends[at] - width)[:, None] + np.arange(width)])
    return by


def _place(shared, dims: int):
    """Adds each vector's width, cell and projection."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            width, cell, spots = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros((n, dims))
            for w, (at, x) in _vectors(batch.column(1)).items():
                width[at], spots[at] = w, projected(x, dims)
                if w in shared.value:
                    cell[at] = cell_of(spots[at], shared.value[w])
            spot = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(spots.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width), pa.array(cell), spot], ["vec_id", "embedding", "width", "cell", "spot"])

    return common.lean(run)


def _search(k: int, dims: int, sure: float):
    def run(cell):
        import pyarrow as pa

        asks, found = np.asarray(cell.column("asks")), []
        if asks.any() and not asks.all():
            ids, known = np.asarray(cell.column("vec_id")), np.asarray(cell.column("known"))
            ((_, x),) = _vectors(cell.column("embedding").combine_chunks()).values()
            found = search_chunk(ids[~asks], x[~asks], ids[asks], x[asks], k, dims, sure, known[asks])
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, kind: str = "array<double>") -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero."""
    fine = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).filter(F.expr(fine))


def _upper(rows: DataFrame, dims: int) -> dict[int, list]:
    """By width: the upper levels, fitted on the ``SAMPLE`` vectors of the least hashes. Other widths have one cell."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    upper = {}
    for width, (_, x) in _vectors(sample).items() if len(sample) else ():
        cells = min(CELLS, 1 + n * len(x) // len(sample) * width * 8 // CELL_BYTES)
        upper[width] = levels(projected(x, dims), max(8, -(-len(x) // cells)))
    return upper


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, dims: int = DIMS, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest by cosine, ranks from 1, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Rows that share
    the query's id are its own; vectors of another length than the query's are no candidates. Of queries that share an
    id the least vector counts; other rows that share an id are candidates each. Empty tables give no rows. Other
    columns are ignored.
    """
    common.small_batches(spark)
    kinds = {f.schema["embedding"].dataType.simpleString() for f in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    rows = usable(vectors, kind)
    shared = spark.sparkContext.broadcast(_upper(rows, dims))
    schema = f"vec_id long, embedding {kind}, width int, cell int, spot array<double>"
    placed = rows.mapInArrow(_place(shared, dims), schema)
    asked = usable(queries, kind).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = common.written(spark, asked.mapInArrow(_place(shared, dims), schema), "ann-queries")
    corner = [F.array(*(f(F.col("spot")[i]) for i in range(dims))).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = common.written(spark, placed.groupBy("width", "cell").agg(F.count("*").alias("c"), *corner).withColumn("parts", F.expr(f"1 + c * width * 8 div {HELD_BYTES}")).drop("c"), "ann-cells")
    near = common.small(boxes.select("width", "cell", "parts"))

    def found_in(asking: DataFrame, name: str) -> DataFrame:
        """Answers to ``asking(vec_id, embedding, width, cell, known)``, each in its cell."""
        turns = common.small(common.written(spark, asking.groupBy("width", "cell").count().selectExpr("width", "cell", f"1 + count * width * 8 div {ASKED_BYTES} AS turns"), f"ann-{name}-turns"))
        of = near.join(turns, ["width", "cell"])
        held = placed.drop("spot").join(F.broadcast(of) if turns.count() <= CELLS else of, ["width", "cell"])
        held = held.select("width", "cell", F.expr("pmod(xxhash64(vec_id, embedding), parts)").alias("part"), F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"), "vec_id", "embedding", F.lit(0.0).alias("known"), F.lit(False).alias("asks"))
        sent = asking.join(F.broadcast(of) if turns.count() <= CELLS else of, ["width", "cell"])
        sent = sent.select("width", "cell", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.expr("pmod(xxhash64(vec_id), turns)").alias("turn"), "vec_id", "embedding", "known", F.lit(True).alias("asks"))
        grouped = held.unionByName(sent).groupBy("width", "cell", "part", "turn")
        return common.written(spark, grouped.applyInArrow(_search(k, dims, sure), "query_id long, vec_id long, score double"), f"ann-{name}")

    nothing = F.lit(float("-inf")).alias("known")
    home = found_in(asked.select("vec_id", "embedding", "width", "cell", nothing), "home")
    ranked = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
    kth = home.selectExpr("query_id", "score AS kth", f"{ranked} AS rank").filter(F.col("rank") == k).select("query_id", "kth")
    # The stopping test against the k-th of the own cell picks the other cells; all of them where fewer were found.
    known = asked.withColumnRenamed("cell", "own").join(kth, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    known = known.withColumn("known", F.coalesce("kth", F.lit(float("-inf"))))
    gap = "aggregate(zip_with(spot, low, (s, l) -> greatest(l - s, 0D)), 0D, (a, x) -> a + x * x) + aggregate(zip_with(spot, high, (s, h) -> greatest(s - h, 0D)), 0D, (a, x) -> a + x * x)"
    others = known.join(common.small(boxes.drop("parts")), "width").filter("cell <> own")
    others = others.filter(F.expr(f"{gap} <= {chi_square_quantile(sure, dims)} * (greatest(0D, 2 - 2 * known) + 1e-12)"))
    far = found_in(others.select("vec_id", "embedding", "width", "cell", "known"), "far")
    return home.unionByName(far).selectExpr("query_id", f"{ranked} AS rank", "vec_id", "score").filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(spark, vectors, vectors.filter("vec_id % 50 = 0"))
