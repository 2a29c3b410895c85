"""Line dedup by a log-template tree.

Each line is parsed into a template: a fixed-depth tree is entered by the number of its tokens and then by its leading
tokens, and tokens that look variable (those with digits, at signs or slashes) are generalised to a wildcard before. In the leaf the line joins the template that agrees with it in the most places, if that share reaches
``similar``; places that differ become wildcards. Templates that occur in at least ``least`` documents are recurring,
and their lines are dropped from all documents. Lines of a few tokens are compared by their exact tokens: nothing in them
is generalised, a leaf holds one such text, and it recurs from ``LEAST_SHORT`` documents on.

Leaves are independent: a leaf's key comes from SQL functions, lines are counted by hashes, so that copies of a line are
one row whatever their number, and only leaves that may hold a recurring template are mined. A leaf's distinct lines
are streamed past its templates, a line against all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

#: Depth of leading tokens, the share of equal places for one template, the documents that make a template recur, and
#: the least tokens of a line that may be generalised: shorter ones (never longer than ``DEPTH``, so that a leaf is one
#: text) are often ordinary, and need ``LEAST_SHORT`` documents. Lines of more than ``LONG_TOKENS`` need ``LEAST_LONG``.
DEPTH, SIMILAR, LEAST, LEAST_TOKENS, LEAST_SHORT = 3, 0.7, 3, 4, 7
LONG_TOKENS, LEAST_LONG = 50, 2
WILD = "<*>"
#: Variable fields: tokens that hold a digit, an at sign or a slash.
FIELD, FIELD_TOKEN = "[0-9@/]", r"[^\s0-9@/]*+[0-9@/]\S*"


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, line, raw): all lines of all texts; raw is a hash of the line."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    return rows.withColumn("raw", F.xxhash64("line"))


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with tokens, n_tokens, leaf and key for line; lines without tokens go. Leaf and key are hashes: of the
    token count with the leading tokens, and of all tokens, generalised in lines of at least ``LEAST_TOKENS``."""
    general = F.when(F.col("line").rlike(FIELD), F.regexp_replace("line", FIELD_TOKEN, WILD)).otherwise(F.col("line"))
    pieces = lambda line: F.regexp_extract_all(line, F.lit(r"\S++"), F.lit(0))
    rows = rows.withColumn("tokens", pieces(general)).withColumn("n_tokens", F.size("tokens")).filter("n_tokens > 0")
    rows = rows.withColumn("tokens", F.when((F.col("n_tokens") < LEAST_TOKENS) & F.col("line").rlike(FIELD), pieces(F.col("line"))).otherwise(F.col("tokens"))).drop("line")
    return rows.withColumns({"leaf": F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)), "key": F.xxhash64("tokens")})


class Leaf:
    """Templates of one leaf, found by the share of equal places; the first of the best is taken."""

    def __init__(self, similar: float = SIMILAR):
        self.similar, self.names, self.known, self.n = similar, {WILD: 0}, None, 0

    def add(self, tokens: list[str]) -> int:
        """The number of the template that the line joins or founds."""
        import numpy as np

        line = np.array([self.names.setdefault(t, len(self.names)) for t in tokens], np.int32)
        if self.n:
            same = (self.known[: self.n] == line).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.similar * len(line):
                self.known[best][self.known[best] != line] = 0
                return best
        if self.known is None or self.n == len(self.known):
            more = np.empty((max(16, 2 * self.n), len(line)), np.int32)
            more[: self.n] = self.known if self.n else 0
            self.known = more
        self.known[self.n] = line
        self.n += 1
        return self.n - 1

    def templates(self) -> list[list[str]]:
        names = list(self.names)
        return [[names[i] for i in t] for t in self.known[: self.n].tolist()] if self.n else []


def _mine(similar: float):
    """Distinct lines, leaf by leaf: each with its template's number within the leaf."""

    def run(batches):
        import pyarrow as pa

        name, leaf = None, None
        for batch in batches:
            out = []
            for key, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2)), strict=True):
                if key != name:
                    name, leaf = key, Leaf(similar)
                out.append(leaf.add(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["leaf", "key", "template"])

    return common.lean(run)


def _enough(least: int):
    """Documents that make a template of a line of ``n_tokens`` recur."""
    return F.when(F.col("n_tokens") < LEAST_TOKENS, max(least, LEAST_SHORT)).when(F.col("n_tokens") > LONG_TOKENS, min(least, LEAST_LONG)).otherwise(least)


def recurring(spark: SparkSession, docs: DataFrame, keyed: DataFrame, similar: float = SIMILAR, least: int = LEAST) -> DataFrame:
    """(leaf, key) of the distinct lines whose template occurs in enough documents. ``keyed``: the lines of
    ``docs`` without their tokens.

    Lines are counted by their hashes first. Of each distinct line in a leaf whose lines together could make a recurring
    template, one is read again by its hash and mined, in the order of the lines' numbers and then of their texts, so
    reruns agree.
    """
    counts = common.written(spark, keyed.groupBy("leaf", "n_tokens", "key").agg(F.count("*").alias("n"), F.min("raw").alias("raw")), "line-counts")
    able = counts.groupBy("leaf", "n_tokens").agg(F.sum("n").alias("total")).filter(F.col("total") >= _enough(least)).select("leaf")
    asked = common.written(spark, counts.join(able, "leaf").select("raw", "n"), "line-asked")
    texts = parsed(split(docs).select("line", "raw").join(common.small(asked), "raw").dropDuplicates(["raw"])).select("leaf", "key", "tokens", "n")
    ordered = texts.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "tokens")
    mined = common.written(spark, ordered.mapInArrow(_mine(similar), "leaf long, key long, template int"), "line-mined")
    where = keyed.join(common.small(mined), ["leaf", "key"]).select("leaf", "n_tokens", "template", "doc_id", "text_hash").distinct()
    often = where.groupBy("leaf", "n_tokens", "template").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= _enough(least))
    return mined.join(often, ["leaf", "template"]).select("leaf", "key")


def dedup(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_dropped and text without the lines of recurring templates.

    Documents are told apart by id and text: equal rows count as one document and each loses the same lines. Blank
    lines stay. Null text: nothing to drop, text null; empty tables give no rows. Other columns are ignored. Lines that
    are as often and alike are mined in the order of their tokens, and a line that fits several templates equally well
    joins the first.
    """
    keyed = common.written(spark, parsed(split(docs)).drop("tokens"), "line-keys")
    bad = common.small(common.written(spark, recurring(spark, docs, keyed, similar, least), "line-recurring"))
    dropped = keyed.join(bad, ["leaf", "key"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drop_at"))
    own = F.col("text").cast("string")
    joined = common.by_key(docs.select("doc_id", "text"), dropped, "left").withColumn("lines", F.when(F.col("drop_at").isNotNull(), F.split(own, "\n")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), drop_at), i -> lines[i]), '\n')")
    return joined.select("doc_id", F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drop_at").isNull(), own).otherwise(kept).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = dedup(spark, common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.crc32("text").alias("text_crc32"))
