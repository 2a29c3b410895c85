from pyspark.sql import functions as F
from world import panel

from causalbars.operators import indicators
from causalbars.sources.tables import BARS, hourly_bars
from causalbars.streaming import bars as streaming


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streamed_crosses_equal_the_batch(spark, tmp_path):
    bars = spark.createDataFrame(panel(3, 150), BARS)
    for lo, hi in ((0, 60), (60, 150)):  # two files, in the order of time
        day = bars.select("date").distinct().orderBy("date").collect()
        part = bars.filter(F.col("date").between(day[lo].date, day[hi - 1].date)).select("symbol", F.col("date").cast("timestamp").alias("ts"), "close")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streaming.streaming_crosses(stream, 6, 30), "crosses", "append")
    want = indicators.crossovers(bars, 6, 30).filter("bull_cross OR bear_cross")
    key = lambda rows: sorted((r.symbol, str(r.ts)[:10], r.bull_cross, r.bear_cross) for r in rows)
    assert key(got.collect()) == key(want.withColumnRenamed("date", "ts").collect()) and want.count() > 5


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    events = spark.range(2000).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 1900 AS int), 0) AS ts", "concat('e', id % 3) AS event_type", "id % 10 AS user_id", "cast(id * 31 % 101 AS double) AS value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run(streaming.streaming_bars(stream), "bars", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, hourly_bars(events).collect()))
    assert run(streaming.sliding_counts(stream), "sliding", "complete").count() > 0
    assert run(streaming.sessions(stream), "sessions", "append").count() >= 0
