"""Connected components of links, distributed: local contraction, then large-star and small-star rounds.

Tasks contract their links to a forest of stars, as they read them, so that memory is in proportion to their nodes. If
the links or their nodes are few (``LINKS``), contraction is repeated until one task has contracted all; else rounds of
large and small stars over the (now few) links follow until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common


#: Links, or else nodes, that a task contracts at a time (its memory is in proportion to the nodes), and links for each
#: node that it may read meanwhile.
LINKS, DENSE = 500_000, 16


def _contract(most: int):
    """A task's links as forests of stars, of about ``most`` links each: nodes with the least node they reach by them."""

    def run(batches):
        import pyarrow as pa

        up: dict[str, str] = {}

        def root(x: str) -> str:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        def forest():
            nodes = list(up)  # each was joined to a smaller one
            for lo in range(0, len(nodes), 10_000):
                own = nodes[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([root(x) for x in own], pa.string())], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > most:
                yield from forest()
                up.clear()
        yield from forest()

    return common.lean(run)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of ``links(u, v)``, both strings: each linked node with the least node it can reach."""
    edges = common.written(spark, links.filter("u <> v").select("u", "v").distinct(), "links")
    few = (n := edges.count()) <= LINKS
    nodes = n if few else edges.select(F.explode(F.array("u", "v")).alias("x")).distinct().count()
    while True:
        tasks = -(-max(min(n, nodes), n // DENSE) // LINKS) or 1
        spread = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "u")
        edges = common.written(spark, spread.mapInArrow(_contract(2 * LINKS), "u string, v string"), "links")
        if tasks == 1 or nodes > LINKS:
            break
        n = edges.count()  # at most a DENSE-th part
    while tasks > 1:
        # Large star: each node's larger neighbours move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node's smaller neighbours and itself move to the least of them.
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct()
        after = common.written(spark, small, "links")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
