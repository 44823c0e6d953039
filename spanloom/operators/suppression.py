"""Greedy suppression of overlapping boxes in rounds, without one group for an image.

A box is dropped if a better one (higher score, then lesser id) that is kept overlaps it by more than the threshold. In a
round every box without an undecided better neighbour is kept and its neighbours are dropped; what is kept equals the
sequential rule. A round settles all boxes at the head of a chain of neighbours; there are as many rounds as the longest
such chain needs, and pairs of settled boxes leave after each.

Neighbours are found on grids: a box lies on at most four cells of the grid that fits its longer side (powers of 2), and
meets larger ones on their grids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, written
from .matching import iou

BOX = ("x1", "y1", "x2", "y2")


def neighbours(boxes: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """(key, better, worse, overlap): boxes of a key whose intersection over union is above the threshold.

    boxes: (key, id, score, x1, y1, x2, y2); those without area have no neighbours, a null score comes after all others.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    own = boxes.where("x1 < x2 and y1 < y2").select(*key, "id", F.coalesce("score", F.lit(float("-inf")).cast("double")).alias("score"), *BOX, F.ceil(F.log2(side)).cast("int").alias("level"))
    levels = sorted(r.level for r in own.select("level").distinct().collect())  # the powers of 2 that occur
    at = F.explode(F.filter(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("level")))
    rows = own.withColumn("grid", at)
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grid")))
    rows = rows.withColumn("i", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("j", F.explode(F.sequence(cell("y1"), cell("y2"))))
    half = lambda p: rows.select(*key, "grid", "i", "j", F.col("id").alias(f"{p}_id"), F.col("score").alias(f"{p}_score"), F.col("level").alias(f"{p}_level"), *(F.col(c).alias(f"{p}_{c}") for c in BOX))
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_id") < F.col("b_id")))
    here = lambda c, n: F.floor(F.greatest(f"a_{c}", f"b_{c}") / F.pow(F.lit(2.0), F.col("grid"))) == F.col(n)
    met = half("a").join(half("b"), [*key, "grid", "i", "j"]).where(first & (F.greatest("a_level", "b_level") == F.col("grid")) & here("x1", "i") & here("y1", "j"))
    return met.withColumn("overlap", iou("a_", "b_")).where(F.col("overlap") > threshold).select(*key, F.col("a_id").alias("better"), F.col("b_id").alias("worse"), "overlap")


def suppress(boxes: DataFrame, key: list[str], threshold: float) -> tuple[DataFrame, int]:
    """boxes without those that a kept better one overlaps by more than the threshold, and the rounds that took.

    Boxes of a key have different ids; a null in the key is a key of no neighbours.
    """
    pairs = written(neighbours(boxes, key, threshold))
    dropped: list[DataFrame] = []
    rounds = 0
    while not pairs.isEmpty():
        rounds += 1
        worse = pairs.select(*key, F.col("worse").alias("better"))
        keep = pairs.select(*key, "better").distinct().join(worse, [*key, "better"], "left_anti")
        gone = written(pairs.join(keep, [*key, "better"], "left_semi").select(*key, "worse").distinct())
        dropped.append(gone)
        # a pair of a settled box says nothing more: the kept ones' neighbours are gone, and the gone hold nobody back
        left = pairs.join(gone, [*key, "worse"], "left_anti").join(gone.withColumnRenamed("worse", "better"), [*key, "better"], "left_anti")
        old, pairs = pairs, written(left)
        removed(old)
    out = boxes
    for gone in dropped:
        out = out.join(gone.withColumnRenamed("worse", "id"), [*key, "id"], "left_anti")
    return out.select(boxes.columns), rounds
