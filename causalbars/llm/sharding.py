"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``2 ** RING_BITS`` cells. Every shard owns several virtual nodes, placed by hash; a row's cell comes from
a hash of its id and text, and its first choice is the next virtual node clockwise. A shard takes no more than its
bound: the rows of a cell that its first choice cannot take go on clockwise to the next virtual node with room. With
bounds of the mean, rounded down or up so that they add up to all rows, counts are at most one apart.

Only the cells' row counts (a table as large as the ring, whatever the data) reach the driver, which lays cells out on
shards as ranges of ranks. Rows find their rank within their cell by a window and their shard by joining that layout,
itself bounded by the ring.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

RING_BITS, VIRTUAL_NODES = 14, 32
LAYOUT = "array<struct<cell:int,lo:bigint,hi:bigint,shard:int,base:bigint>>"


def ring(spark: SparkSession, shards: int, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. Adding a shard adds its nodes and moves no other."""
    at = spark.range(shards * nodes).select(F.expr(f"shiftrightunsigned(xxhash64(id div {nodes}, id % {nodes}, 'node'), {64 - RING_BITS})").cast("int").alias("cell"), F.expr(f"cast(id div {nodes} as int)").alias("shard"))
    return sorted((r.cell, r.shard) for r in at.collect())


def layout(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int, slack: float = 0.0) -> list[dict]:
    """Ranges of ranks for shards: ``counts`` rows per cell, laid on the ring under bounded loads."""
    cells, owner = [c for c, _ in nodes], [s for _, s in nodes]
    first = {cell: bisect.bisect_left(cells, cell) % len(nodes) for cell in counts}
    total, wanted = sum(counts.values()), [0] * shards
    for cell, n in counts.items():
        wanted[owner[first[cell]]] += n
    if slack:
        room = [-int(-total * (1 + slack) // shards)] * shards
    else:  # the shards that most rows want take the rows that are left over
        room = [total // shards] * shards
        for s in sorted(range(shards), key=lambda s: (-wanted[s], s))[: total % shards]:
            room[s] += 1
    ahead = list(range(len(nodes)))  # of each node: itself, or a later one nearer to room

    def next_with_room(v: int) -> int:
        path = []
        while True:
            path.append(v)
            if ahead[v] != v:
                v = ahead[v]
            elif room[owner[v]]:
                break
            else:
                ahead[v] = (v + 1) % len(nodes)
                v = ahead[v]
        for u in path:
            ahead[u] = v
        return v

    spans, over = [], []
    for cell in sorted(counts):
        s = owner[first[cell]]
        n = min(counts[cell], room[s])
        room[s] -= n
        if n:
            spans.append([cell, 0, n, s])
        if n < counts[cell]:
            over.append((cell, n))
    for cell, lo in over:
        while lo < counts[cell]:
            s = owner[next_with_room(first[cell])]
            n = min(counts[cell] - lo, room[s])
            room[s] -= n
            spans.append([cell, lo, lo + n, s])
            lo += n
    base, out = [0] * shards, []
    for cell, lo, hi, s in sorted(spans):
        out.append({"cell": cell, "lo": lo, "hi": hi, "shard": s, "base": base[s]})
        base[s] += hi - lo
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int, nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, shard and slot (0, 1, ...
    without gaps within the shard).

    Without slack no two shards differ by more than one row; with it a shard takes up to ``1 + slack`` times the mean.
    Null text: as empty, null ids are hashed as such. Equal rows are interchangeable and may part; an empty table gives
    no rows. Rows with one id and many texts spread over the ring, as its cells hash both.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.col("doc_id"), text).alias("at"))
    rows = rows.withColumn("cell", F.expr(f"shiftrightunsigned(at, {64 - RING_BITS})").cast("int"))
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    spans = json.dumps(layout(ring(spark, shards, nodes), counts, shards, slack))
    spans = spark.range(1).select(F.inline(F.from_json(F.lit(spans), LAYOUT)))
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY cell ORDER BY at, doc_id, text_crc32, size) - 1 AS rank")
    placed = ranked.join(F.broadcast(spans), "cell").filter("rank >= lo AND rank < hi")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(spark, common.table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
