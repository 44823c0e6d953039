"""Neighbours along a long key without a window over all of it: first within spans of positions, then along the spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spans that a key's positions are cut into: a window holds one span, or one row for each span of a key.
SPAN = 1 << 30
#: Rows of a task where keys are dealt by their number.
ROWS = 500_000


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt by key into as many parts as their number asks for, so that a task's share doesn't grow with the table.

    Few rows are left as they are, for Spark's own partitions serve them.
    """
    parts = -(-rows.count() // ROWS)
    return rows.repartition(parts, *key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _spans(rows: DataFrame, key: str, at: str, span: int) -> DataFrame:
    return rows.withColumn("_span", F.floor(F.col(at) / span))


def following(rows: DataFrame, key: str, at: str, value: str, span: int = SPAN) -> DataFrame:
    """rows with `next_<value>`: that of the key's next row by position (positions of a key differ)."""
    cut = _spans(rows, key, at, span)
    firsts = cut.groupBy(key, "_span").agg(F.min_by(F.struct(value), at).alias("_head"))
    heads = firsts.select(key, "_span", F.lead("_head").over(W.partitionBy(key).orderBy("_span")).alias("_next"))
    own = F.lead(F.struct(value)).over(W.partitionBy(key, "_span").orderBy(at))
    near = cut.withColumn("_own", own).join(heads, [key, "_span"])
    return near.withColumn(f"next_{value}", F.coalesce("_own", "_next")[value]).drop("_span", "_own", "_next")


def preceding(rows: DataFrame, key: str, at: str, value: str, span: int = SPAN) -> DataFrame:
    """rows with `last_<value>`: the last value that isn't null before the row, along its key."""
    cut = _spans(rows, key, at, span)
    along = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    tails = cut.groupBy(key, "_span").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_tail"))
    tails = tails.select(key, "_span", F.last("_tail", ignorenulls=True).over(along).alias("_before"))
    inside = W.partitionBy(key, "_span").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    near = cut.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(tails, [key, "_span"])
    return near.withColumn(f"last_{value}", F.coalesce("_own", "_before")).drop("_span", "_own", "_before")


def coming(rows: DataFrame, key: str, at: str, value: str, span: int = SPAN) -> DataFrame:
    """rows with `coming_<value>`: the first value that isn't null behind the row, along its key."""
    back = rows.withColumn("_back", -F.col(at))
    return preceding(back, key, "_back", value, span).withColumnRenamed(f"last_{value}", f"coming_{value}").drop("_back")
