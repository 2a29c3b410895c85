"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of transformed statistics. Class means and scatter matrices are sums over all
labelled rows of the training fold, added up by Spark; only these sums (classes x features squared) reach the driver.
Covariances are shrunk to their pooled average and to a multiple of the identity. A score is the logistic of the
difference of log densities, Mahalanobis distances by way of cached Cholesky factors, and of the log prior odds.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

#: Shares of the pooled covariance and of the scaled identity, and the score from which a document is kept.
POOLED, RIDGE, KEEP = 0.1, 0.01, 0.3

_KIND = np.zeros(256, np.int64)
for _byte in range(256):
    _c = chr(_byte)
    _KIND[_byte] = 0 if _byte >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t\r\x0b\x0c" else 5 if _c == "\n" else 6 if _c in ".,;:'\"()-" else 7 if _byte >= 32 else 8
FEATURES = 14


def features(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; all defined for an empty one."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = len(data)
    seen = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=seen, minlength=9)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    w, l = max(len(words), 1), max(len(lines), 1)  # noqa: E741
    letters = kinds[0] + kinds[1] + kinds[2]
    p = seen[seen > 0] / max(n, 1)
    logit = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5 + 0.02 * whole))
    return [
        math.log1p(len(words)),
        math.log((n + 1) / w),
        logit(kinds[2], letters),
        logit(kinds[7], n),
        logit(kinds[6], n),
        logit(kinds[3], n),
        logit(kinds[5], n),
        logit(kinds[4] + kinds[5], n),
        logit(kinds[0], n),
        math.sqrt(len(set(words)) / w),
        math.sqrt(1 - len(set(lines)) / l) if lines else 0.0,
        math.log((len(words) + 1) / l),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        logit(kinds[8], n),
    ]


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])


def extract(docs: DataFrame) -> DataFrame:
    """``docs`` with its last column, the text, replaced by x, the text's statistics."""
    *rest, _ = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.mapInArrow(common.lean(_extract), f"{schema}, x array<double>")


def _moments(batches):
    import pyarrow as pa

    total = {}
    for batch in batches:
        x = np.asarray(batch.column(1).flatten()).reshape(-1, FEATURES)
        y = np.asarray(batch.column(0))
        for label in (0, 1):
            own = x[y == label]
            one = np.hstack([np.ones((len(own), 1)), own])
            total[label] = total.get(label, 0) + one.T @ one
    for label, m in total.items():
        flat = m.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), label), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["label", "at", "v"])


def fit(labelled: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> dict:
    """Model of ``labelled(label, x)``. A class without rows leaves only the prior: then all documents score alike."""
    sums = labelled.mapInArrow(common.lean(_moments), "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    d = FEATURES + 1
    moments = {label: np.zeros(d * d) for label in (0, 1)}
    for r in sums:
        moments[r.label][r.at] = r.v
    moments = {k: m.reshape(d, d) for k, m in moments.items()}
    counts = {k: float(m[0, 0]) for k, m in moments.items()}
    model = {"prior": (counts[1] + 1) / (counts[0] + counts[1] + 2), "classes": None}
    if min(counts.values()) < 2:
        return model
    means = {k: m[0, 1:] / counts[k] for k, m in moments.items()}
    covs = {k: m[1:, 1:] / counts[k] - np.outer(means[k], means[k]) for k, m in moments.items()}
    both = sum(counts[k] * covs[k] for k in covs) / sum(counts.values())
    unit = np.diag(np.maximum(np.diag(both), 1e-6))  # the identity on the features' own scales
    model["classes"] = []
    for k in (0, 1):
        cov = (1 - pooled - ridge) * covs[k] + pooled * both + ridge * unit
        low = np.linalg.cholesky(cov)
        model["classes"].append((means[k].tolist(), np.linalg.inv(low).tolist(), float(2 * np.log(np.diag(low)).sum())))
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    odds = np.full(len(x), math.log(model["prior"] / (1 - model["prior"])))
    if model["classes"]:
        logs = []
        for mean, whiten, logdet in model["classes"]:
            z = (x - np.asarray(mean)) @ np.asarray(whiten).T
            logs.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        odds = odds + logs[1] - logs[0]
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _score(model: dict, batches):
    import pyarrow as pa

    for batch in batches:
        x = np.asarray([features(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(model, x))], [*batch.schema.names[:-1], "score"])


HELD_OUT = "crc32(coalesce(cast(doc_id AS string), '')) % 5 = 0"


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """Model of the labelled documents that are not held out (crc32 of the id as text is not divisible by 5).

    An id with several labels has the least of them; null ids and other labels than 0 and 1 are none.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = common.small(common.written(spark, known, "quality-labels"))
    return fit(extract(docs.filter(f"NOT ({HELD_OUT})").join(known, "doc_id").select("label", F.col("text").cast("string").alias("text"))))


def classify(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out and score. Null text: as empty; a null id is not held out unless
    crc32 of the empty text says so. Without labelled rows of either class all scores are the smoothed share of label 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.lean(functools.partial(_score, model)), "doc_id long, held_out boolean, score double")


def _filter(model: dict, at: int, keep: float, batches):
    import pyarrow as pa

    for batch in batches:
        x = np.asarray([features(t.as_py()) for t in batch.column(at)]).reshape(-1, FEATURES)
        yield batch.filter(pa.array(scores(model, x) >= keep))


def keep(docs: DataFrame, model: dict, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    return docs.mapInArrow(common.lean(functools.partial(_filter, model, docs.columns.index("text"), least)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    found = classify(spark, docs, train(spark, docs, common.table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
