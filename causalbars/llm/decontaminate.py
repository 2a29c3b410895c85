"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

A benchmark item is a set of windows of ``size`` consecutive words (a shorter item is one window). A window occurs in
a document only if each of its words does, so one necessary word suffices as its prefix: words are ordered by rarity,
counted over all documents, and the window's rarest word is joined with the documents' words. The word's place in the
window then fixes the only start that a match can have: starts outside the document are dropped (length and
positional bounds) and the rest are compared word by word with the window.

Both passes stream the documents' words past a broadcast table of the benchmark. The table's size is measured first;
a benchmark above ``block_bytes`` is taken in blocks of windows, each within that bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW = r"[0-9A-Za-z\x80-\x{10FFFF}]++"
#: Bytes of windows that one broadcast may hold.
BLOCK_BYTES = 32 << 20


def raw_words(text: Column) -> Column:
    """The runs of characters that are ASCII letters, digits or beyond ASCII, as they are written."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(RAW), F.lit(0))


def lowered(word: Column) -> Column:
    """A word with A-Z lower-cased; most words are in lower case already."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(wid, window, item): each item, as a string, with its distinct windows and their names. A window's words are
    joined by spaces."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.transform(raw_words(F.col("text")), lowered).alias("w")).filter("item IS NOT NULL AND size(w) > 0")
    starts = own.withColumn("at", F.explode(F.expr(f"sequence(0, greatest(size(w) - {size}, 0))")))
    return starts.select("item", F.array_join(F.expr(f"slice(w, at + 1, {size})"), " ").alias("window")).select(F.md5("window").alias("wid"), "window", "item").distinct()


def _prefixed(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(token, place, wid, window, length): each window that can occur, under its rarest word, and its number of words."""
    own = windows.select("*", F.split("window", " ").alias("w"))
    vocabulary = own.select(F.explode("w").alias("token")).distinct()
    # Outer, as the inner one makes the optimizer find all words twice, to test whether there are any.
    seen = docs.select(F.explode_outer("w").alias("word")).select(lowered(F.col("word")).alias("token"))
    counts = seen.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    places = own.select("wid", "window", F.size("w").alias("length"), F.posexplode("w").alias("place", "token"))
    rarest = places.join(F.broadcast(counts), "token", "left").groupBy("wid", "window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("p"))
    return rarest.filter("p.n > 0").select("p.token", "p.place", "wid", "window", "length")


def search(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``documents``: doc_id, text_hash (xxhash64 of the text), n_words, hits (sorted, disjoint word ranges ``start``/``end`` that
    item windows cover) and items (sorted ids, as strings, of the items with occurring windows).

    A null text has no words; a text may be as long as a task's memory allows. Items without id or without words take no
    part; items that share an id count as one. Repeated rows give a row each. Other columns of either table are ignored.
    An empty table of documents gives no rows, an empty benchmark rows without hits.
    """
    docs = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), raw_words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    held = common.written(spark, item_windows(benchmark, size), "windows")
    windows = held.select("wid", "window").distinct()
    total = windows.agg(F.sum(F.expr("200 + octet_length(window)"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1
    found = []
    for block in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == block) if blocks > 1 else windows
        prefixed = common.written(spark, _prefixed(docs, own), "prefixes")
        at = docs.select("row", "doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("at", "word"))
        match = (
            (lowered(at["word"]) == prefixed["token"])
            & (F.col("at") >= F.col("place"))
            & (F.col("at") - F.col("place") + F.col("length") <= F.col("n_words"))
            & (F.translate(F.array_join(F.expr("slice(w, at - place + 1, length)"), " "), UPPER, LOWER) == F.col("window"))
        )
        hits = at.join(F.broadcast(prefixed), match, "left")
        # The first word's row stays without a match too: each document must come through once at least.
        hits = hits.filter("wid IS NOT NULL OR at IS NULL OR at = 0").select("row", "doc_id", "text_hash", "n_words", "wid", F.expr("IF(wid IS NULL, NULL, struct(at - place AS start, at - place + length AS end))").alias("hit"))
        found.append(hits)
    hits = common.written(spark, reduce(DataFrame.unionByName, found), "hits")
    per = hits.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    items = hits.filter("wid IS NOT NULL").select("row", "wid").distinct().join(held.select("wid", "item"), "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    merged = """aggregate(hits, cast(array() as array<struct<start:int,end:int>>), (done, x) ->
        IF(size(done) > 0 AND element_at(done, -1).end >= x.start,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start AS start, greatest(element_at(done, -1).end, x.end) AS end))),
           concat(done, array(struct(x.start AS start, x.end AS end)))))"""
    return per.join(items, "row", "left").select("doc_id", "text_hash", "n_words", F.expr(merged).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``documents`` without those in which a window of an item occurs, null and empty texts among the rest, with all
    their columns, whatever their names."""
    found = search(spark, documents, benchmark, size).filter("size(items) > 0").select("doc_id", "text_hash").distinct()
    return common.by_key(documents, found, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, array_to_string(w[p + 1 : p + 10], ' ') AS win, least(len(w), 10) AS k
       FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, p, array_to_string(w[p + 1 : p + k], ' ') AS win
       FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.rid, dw.p, dw.k, iw.item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
pos AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.rid = d.rid LEFT JOIN its ON its.rid = d.rid
"""
