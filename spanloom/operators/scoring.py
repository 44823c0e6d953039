"""Counts, rates and their intervals, latest rows, comparisons, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The 95 % score interval of k successes in n; null where n is 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def rates(df: DataFrame, key: list[str], success: Column) -> DataFrame:
    """(key, n, k, rate, low, high)."""
    counted = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(success).alias("k"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return counted.withColumns({"rate": F.col("k") / F.col("n"), "low": low, "high": high})


def latest(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each key's row of the greatest `order`, which is unique within the key."""
    newest = df.groupBy(*key).agg(F.max(F.struct(order, *columns)).alias("row"))
    return newest.select(*key, f"row.{order}", *(f"row.{c}" for c in columns))


def stage_breakdown(df: DataFrame, key: list[str], stages: list[str], total: str) -> DataFrame:
    """(key, stage, seconds, share): a row for each stage and `other`, what the stages leave of the total."""
    other = F.greatest(F.lit(0.0), F.col(total) - sum((F.col(s) for s in stages), F.lit(0.0)))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(k).alias("pos"), F.col(s).alias("seconds")) for k, s in enumerate(stages)), F.struct(F.lit("other").alias("stage"), F.lit(len(stages)).alias("pos"), other.alias("seconds")))
    return df.select(*key, F.col(total).alias("total"), F.inline(rows)).withColumn("share", F.when(F.col("total") > 0, F.col("seconds") / F.col("total")))


def bottleneck(stages: DataFrame, key: list[str], dominant: float = 0.5, least_total: float = 0.05) -> DataFrame:
    """(key, stage, dominant): the slowest stage, `other` among them, the first of equals; none where the total is too small."""
    top = stages.where(F.col("total") >= least_total).groupBy(*key).agg(F.min(F.struct((-F.col("seconds")).alias("slow"), "pos", "stage", "share")).alias("top"))
    return top.select(*key, "top.stage", (F.col("top.share") >= dominant).alias("dominant"))


def against_first(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of keys with two rows or more, with the difference to and the ratio over the key's first row."""
    w = W.partitionBy(*key).orderBy(*order)
    base = F.first(value).over(w)
    n = F.count("*").over(W.partitionBy(*key))
    return df.withColumns({"n": n, "delta": F.col(value) - base, "ratio": F.when(base != 0, F.col(value) / base)}).where("n >= 2")


def average_ranks(df: DataFrame, key: list[str], column: str, name: str) -> DataFrame:
    """df with the mean rank of tied rows.

    Keys may be few and large, so values are counted, sorted by range and summed up along the ranges: no task holds a key.
    """
    own = [*key, column]
    counts = df.groupBy(*own).agg(F.count("*").alias("_n")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(own)), "_n")
    order = [f"_k{i}" for i in range(len(own))]
    spread = written(counts.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    sizes = spread.groupBy("_part").agg(F.sum("_n").alias("_all"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_all").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = spread.withColumn("_upto", upto).join(F.broadcast(before), "_part").withColumn("_first", F.col("_before") + F.col("_upto") - F.col("_n"))
    starts = placed.groupBy(*order[:-1]).agg(F.min("_first").alias("_start")).select(*(F.col(c).alias(f"{c}s") for c in order[:-1]), "_start")
    same = lambda pairs: reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs], F.lit(True))
    ranked = placed.join(starts, same([(c, f"{c}s") for c in order[:-1]])).select(*order, (F.col("_first") - F.col("_start") + 1 + (F.col("_n") - 1) / 2).alias("_rank"))
    rows = df.select("*", *(F.col(c).alias(f"_own{i}") for i, c in enumerate(own)))
    met = rows.join(ranked, same([(f"_own{i}", c) for i, c in enumerate(order)]))
    return met.select(*df.columns, F.col("_rank").alias(name))


def spearman(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(key, n, rho): null for fewer than 3 rows or a constant side."""
    ranked = average_ranks(average_ranks(df, key, x, "rank_x"), key, y, "rank_y")
    spread = F.stddev_pop("rank_x") * F.stddev_pop("rank_y")
    rho = F.covar_pop("rank_x", "rank_y") / F.nullif(spread, F.lit(0.0))
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, rho).alias("rho"))


def robust_outliers(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, n, middle, mad, outliers): outliers are further from the median than max(3 * 1.4826 * MAD, 1)."""
    middle = df.groupBy(*key).agg(F.median(value).alias("middle"))
    apart = df.join(middle, key).withColumn("apart", F.abs(F.col(value) - F.col("middle")))
    mad = apart.groupBy(*key).agg(F.median("apart").alias("mad"))
    return apart.join(mad, key).groupBy(*key, "middle", "mad").agg(F.count("*").alias("n"), F.count_if(F.col("apart") > F.greatest(F.lit(3 * 1.4826) * F.col("mad"), F.lit(1.0))).alias("outliers"))


def band(x: Column) -> Column:
    return F.when(x >= 0.9, "high").when(x >= 0.5, "medium").when(x.isNotNull(), "low").otherwise("unknown")


def missed_thresholds(metrics: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of each rule (key, least): ok, below or missing."""
    verdict = F.when(F.col("value").isNull(), "missing").when(F.col("value") < F.col("least"), "below").otherwise("ok")
    return rules.join(metrics.select(key, "value"), key, "left").select(key, verdict.alias("verdict"))
