"""Readers and adapters: bars, dividends and benchmark levels from files or from the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
DIVIDENDS = "symbol string, ex_date date, dps double"
INDEX_LIST = "company_name string, industry string, symbol string, series string, isin string"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars of a folder of files; CSV files have a header. NaN becomes NULL, rows without close are no bars."""
    reader = spark.read.schema(BARS)
    bars = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    prices = ("open", "high", "low", "close", "volume")
    return bars.select("symbol", "date", *(F.nanvl(c, F.lit(None)).alias(c) for c in prices)).filter("close IS NOT NULL")


def read_index_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of an index list (CSV with a header): trimmed, distinct, sorted."""
    rows = spark.read.schema(INDEX_LIST).csv(path, header=True)
    return rows.select(F.trim("symbol").alias("symbol")).filter("symbol <> ''").distinct().orderBy("symbol")


def merge_cache(cached: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Upsert: fresh rows win where keys overlap, other cached rows stay."""
    return cached.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def cache_hits(cached: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols whose cache covers a request: it begins at most 10 days late and ends at most 7 days early."""
    per = cached.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return per.withColumn("hit", (F.col("first") <= F.date_add(F.lit(start).cast("date"), 10)) & (F.col("last") >= F.date_sub(F.lit(end).cast("date"), 7)))


def parse_benchmark(raw: DataFrame, body: str = "body") -> DataFrame:
    """Index levels of a response whose field ``d`` is itself a JSON text: (date, level).

    Dates come in several day-first formats, levels with thousands separators; rows that are neither are dropped.
    """
    rows = raw.select(F.explode(F.from_json(F.get_json_object(body, "$.d"), "array<map<string,string>>")).alias("r"))
    day = F.expr("element_at(filter(map_entries(r), e -> contains(lower(e.key), 'date')), 1).value")
    level = F.expr("element_at(filter(transform(filter(map_entries(r), e -> NOT contains(lower(e.key), 'date')), e -> try_cast(replace(e.value, ',', '') AS double)), x -> x IS NOT NULL), -1)")
    parsed = F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in ("dd MMM yyyy", "dd-MMM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd"))).cast("date")
    return rows.select(parsed.alias("date"), level.alias("level")).filter("date IS NOT NULL AND level IS NOT NULL").orderBy("date")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    """Bars by supplier and week from ``lineitem``: unit prices in whole cents, first and last line of the week.

    Cents are whole numbers in doubles, so sums are exact in any order and crossovers never hang on a last digit.
    ``by_symbol`` sends the lines to their symbols as they are: a week has few lines, and a line is narrower than the
    first and last line that a partial result holds.
    """
    lines = load(spark, sf_dir, "lineitem").select(
        F.format_string("S%05d", "l_suppkey").alias("symbol"),
        F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date"),
        F.round(F.col("l_extendedprice").cast("double") * 100 / F.col("l_quantity").cast("double")).alias("px"),
        F.col("l_quantity").cast("double").alias("q"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"),
    )
    lines = lines.repartition("symbol") if by_symbol else lines
    return lines.groupBy("symbol", "date").agg(F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("q").alias("volume"))


def weekly_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as dividends: tax rate in cents per share on the ship date."""
    lines = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    cents = F.round(F.col("l_tax").cast("double") * 100)
    return lines.groupBy(F.format_string("S%05d", "l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("ex_date")).agg(F.sum(cents).alias("dps")).filter("dps > 0")


def order_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, level) by week: orders' average price in whole cents."""
    orders = load(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "week").alias("date"), F.round(F.col("o_totalprice").cast("double") * 100).alias("c"))
    return orders.groupBy("date").agg(F.round(F.sum("c") / F.count("*")).alias("level"))


def hourly_bars(events: DataFrame) -> DataFrame:
    """Bars by event type and hour; also runs over a stream of events with a watermark on ``ts``."""
    o = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), F.window("ts", "1 hour").alias("w")).agg(F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.count("*").cast("double").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
