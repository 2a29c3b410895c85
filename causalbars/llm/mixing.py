"""Mixing sources to target weights by entropy balancing.

Sources get targets (words) from their weights by water-filling under a cap of ``cap`` times their own size. Document
rates of least relative entropy to "each once" under those token constraints, none above ``cap``, are exponentially
tilted: ``min(cap, exp(lambda * c))`` with c the document's size over its source's mean. The convex dual is solved by
safeguarded Newton steps, each one aggregation over the corpus' histogram (source, size, count), which is exact, as
documents of a source and size share a rate. Every few steps the state goes to the shared folder.

Rates are rounded into copies by systematic rounding down the sizes of each source; what is then missing or too much is
made up with the smallest documents that have room. Copies of a (source, size) group go to its documents in hash order,
in sub-groups where a group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
#: Newton steps between writes, writes at most, and the relative error of a source's words that ends them.
STEPS, ROUNDS, CLOSE = 4, 12, 1e-6
#: Documents of one (source, size) group that are ranked in one task, about.
SUB = 20_000


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(hist: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, source, source_size, n, target) of ``hist(source, size, n)``; sources by code point, null last, take the
    weights in turn. Targets add up to all words; those above the cap stop there and the rest is shared by weight."""
    hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")).createOrReplaceTempView("mixing_sources")
    turn = f"element_at(array({', '.join(f'{float(w)}D' for w in weights)}), cast((src - 1) % {len(weights)} + 1 AS int))"
    return hist.sparkSession.sql(f"""
        WITH s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM mixing_sources),
        w AS (SELECT *, {turn} AS weight, {cap} * source_size / {turn} AS full_at FROM s),
        c AS (SELECT *, sum(source_size) OVER () AS total,
                     coalesce(sum({cap} * source_size) OVER (ORDER BY full_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
                     sum(weight) OVER (ORDER BY full_at, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
        l AS (SELECT *, (total - full_before) / weight_left AS level FROM c),
        -- The first source, by the level at which it is full, that the water does not fill sets the level of the rest.
        m AS (SELECT *, min(CASE WHEN level <= full_at THEN struct(full_at, src, level) END) OVER () AS at FROM l)
        SELECT src, source, source_size, n, least(weight * at.level, cast({cap} * source_size AS double)) AS target FROM m""")


def tilt(spark: SparkSession, cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """(src, lam): the dual's solution. ``cells(src, size, n)``. lam is null where the target is all or nothing:
    ``rate`` (0 or cap) then holds."""
    scale = F.col("source_size") / F.col("n")
    start = sources.select(
        "src",
        "target",
        scale.alias("scale"),
        F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(float(cap))).alias("rate"),
        F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(0.0).alias("lam"),
        F.lit(-60.0).alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.lit(1.0).alias("err"),
    )
    state = common.written(spark, start, "mixing-dual")
    done, live = [state.filter("rate IS NOT NULL")], state.filter("rate IS NULL")
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            c, raw = F.col("size") / F.col("scale"), F.col("lam") * F.col("size") / F.col("scale")
            free = raw < F.log(F.lit(float(cap)))
            own = F.when(free, F.exp(F.least(raw, F.lit(50.0)))).otherwise(F.lit(float(cap)))
            sums = cells.join(live, "src").groupBy("src").agg(F.sum(F.col("n") * F.col("size") * own).alias("f"), F.sum(F.when(free, F.col("n") * F.col("size") * c * own).otherwise(0.0)).alias("df"))
            moved = live.join(sums, "src").withColumns({"lo": F.when(F.col("f") <= F.col("target"), F.greatest("lam", "lo")).otherwise(F.col("lo")), "hi": F.when(F.col("f") >= F.col("target"), F.coalesce(F.least("lam", "hi"), F.col("lam"))).otherwise(F.col("hi"))})
            newton = F.col("lam") - (F.col("f") - F.col("target")) / F.nullif(F.col("df"), F.lit(0.0))
            inside = (newton > F.col("lo")) & (F.col("hi").isNull() | (newton < F.col("hi")))
            halved = F.when(F.col("hi").isNull(), F.greatest(F.col("lam") * 2, F.col("lam") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
            err = F.abs(F.col("f") / F.col("target") - 1)
            step = F.when(err < 1e-12, F.col("lam")).when(inside, newton).otherwise(halved)
            live = moved.select("src", "target", "scale", "rate", step.alias("lam"), "lo", "hi", err.alias("err"))
        live = common.written(spark, live, "mixing-dual")
        if (live.agg(F.max("err")).first()[0] or 0.0) < CLOSE:
            break
    return done[0].unionByName(live).select("src", "scale", "rate", "lam")


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (xxhash64 of the text), size, source_size, target (its source's) and copies (0 to ``cap``).

    A null text has size 0 and one copy; a null source is a source, the last. Documents that share an id are documents
    of their own; equal rows are interchangeable. An empty table gives no rows.
    """
    sized = common.written(spark, sizes(docs), "mixing-sizes")
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = common.written(spark, targets(hist, weights, cap), "mixing-sources")
    cells = hist.alias("h").join(sources.select("src", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("src", "size", "n")
    cells = common.written(spark, cells, "mixing-cells")
    dual = tilt(spark, cells, sources, cap)
    rate = F.coalesce("rate", F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    rated = cells.join(dual, "src").join(sources.select("src", "target"), "src").select("src", "target", "size", "n", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate).alias("rate"))
    rated.createOrReplaceTempView("mixing_rated")
    # Whole copies down the sizes; then the smallest with room take or give what is left of the target.
    copies = spark.sql(f"""
        WITH a AS (SELECT *, sum(n * rate) OVER (PARTITION BY src ORDER BY size DESC) AS upto FROM mixing_rated),
        b AS (SELECT *, least({cap} * n, greatest(0, cast(floor(upto + 0.5) - floor(upto - n * rate + 0.5) AS bigint))) AS k FROM a),
        d AS (SELECT *, target - sum(k * size) OVER (PARTITION BY src) AS short FROM b),
        e AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN short > 0 THEN {cap} * n - k ELSE k END AS room FROM d),
        f AS (SELECT *, coalesce(sum(room * size) OVER (PARTITION BY src ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
        SELECT src, size, n, k + CASE WHEN size = 0 THEN 0 ELSE cast(sign(short) * floor(least(greatest(abs(short) - before, 0), room * size) / size) AS bigint) END AS k FROM f""")
    copies = common.written(spark, copies, "mixing-copies")
    named = copies.join(sources.select("src", "source", "source_size", "target"), "src").select("src", F.col("source").alias("s"), F.col("size").alias("z"), "n", "k", "source_size", "target")
    own = sized.withColumn("h", F.xxhash64("doc_id", "size")).join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn("sub", F.expr(f"pmod(h, n div {SUB} + 1)"))
    subs = own.groupBy("src", "size", "sub").agg(F.count("*").alias("m")).selectExpr("src AS src2", "size AS size2", "sub AS sub2", "sum(m) OVER (PARTITION BY src, size ORDER BY sub) - m AS before")
    ranked = own.join(subs, (F.col("src") == F.col("src2")) & (F.col("size") == F.col("size2")) & (F.col("sub") == F.col("sub2"))).selectExpr("*", "before + row_number() OVER (PARTITION BY src, size, sub ORDER BY h, doc_id) AS place")
    return ranked.selectExpr("doc_id", "text_hash", "size", "source_size", "target", "cast(floor(place * k / n) - floor((place - 1) * k / n) AS int) AS copies")


def mixed(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Equal rows get equal parts of their copies, rounded."""
    name, place = common.fresh("_copies", docs), common.fresh("_copy", docs)
    taken = mix(spark, docs, weights, cap).groupBy("doc_id", "text_hash").agg(F.round(F.avg("copies")).cast("int").alias(name))
    columns = [f"`{c}`" for c in docs.columns]
    return common.by_key(docs, taken.filter(f"{name} > 0"), "inner").selectExpr(*columns, f"explode(sequence(1, {name})) AS {place}").drop(place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark, common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
