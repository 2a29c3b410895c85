"""Exchange sessions and the audit of a panel against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.operators.panel import dense


def phantom(calendar: DataFrame, sessions: DataFrame) -> DataFrame:
    """Panel dates on which the exchange was closed."""
    return calendar.select("date").join(sessions.select("date"), "date", "left_anti")


def missing(calendar: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions within the panel's span of which the panel has nothing."""
    span = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = sessions.select("date").distinct().join(F.broadcast(span)).filter("date BETWEEN lo AND hi").select("date")
    return inside.join(calendar.select("date"), "date", "left_anti")


def gaps(bars: DataFrame, calendar: DataFrame, sessions: DataFrame, least: int = 10) -> DataFrame:
    """Symbols with at least ``least`` sessions on the panel without a bar: (symbol, n_missing)."""
    own = dense(bars, calendar).join(F.broadcast(sessions.select("date").distinct()), "date", "left_semi")
    return own.groupBy("symbol").agg(F.count_if(F.col("close").isNull()).alias("n_missing")).filter(F.col("n_missing") >= least)


def audit(bars: DataFrame, calendar: DataFrame, sessions: DataFrame, least: int = 10, worst: int = 8) -> DataFrame:
    """One row: sizes, the dates that disagree, the symbols with most gaps, and whether all is clean."""
    days = lambda df: df.agg(F.array_sort(F.collect_list("date")).alias("d"))
    top = gaps(bars, calendar, sessions, least).orderBy(F.desc("n_missing"), "symbol").limit(worst)
    listed = top.agg(F.collect_list(F.struct("n_missing", "symbol")).alias("g"))
    out = calendar.agg(F.count("*").alias("panel_days")).join(days(phantom(calendar, sessions)).withColumnRenamed("d", "phantom")).join(days(missing(calendar, sessions)).withColumnRenamed("d", "missing")).join(listed.withColumnRenamed("g", "worst_gaps"))
    return out.withColumn("clean", (F.size("phantom") == 0) & (F.size("missing") == 0))


def report(audit_row) -> str:
    """The audit as text."""
    lines = [f"panel days: {audit_row['panel_days']}", f"phantom days: {len(audit_row['phantom'])}", f"missing sessions: {len(audit_row['missing'])}"]
    lines += [f"  {d} is not a session" for d in audit_row["phantom"][:10]] + [f"  {d} has no bars" for d in audit_row["missing"][:10]]
    lines += [f"  {g['symbol']}: {g['n_missing']} bars missing" for g in audit_row["worst_gaps"]]
    return "\n".join([*lines, "clean" if audit_row["clean"] else "not clean"])


def is_session(sessions: DataFrame, dates: DataFrame) -> DataFrame:
    found = sessions.select("date").distinct().withColumn("is_session", F.lit(True))
    return dates.join(F.broadcast(found), "date", "left").withColumn("is_session", F.coalesce("is_session", F.lit(False)))


def previous_session(sessions: DataFrame, dates: DataFrame, days: int = 20) -> DataFrame:
    """The last session before each date within ``days`` calendar days, else NULL."""
    # Each session reaches ``days`` days ahead: an equi-join on the day instead of a range join.
    ahead = sessions.select(F.col("date").alias("s"), F.explode(F.expr(f"sequence(date_add(date, 1), date_add(date, {days}))")).alias("date"))
    return dates.join(ahead.groupBy("date").agg(F.max("s").alias("previous_session")), "date", "left")
