"""Hash-chained logs, job graphs, access, text and byte-range records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

GENESIS = "0" * 64


def chain_heads(log: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, head): sha256(previous hash + payload) folded along each key's log, from GENESIS."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "payload")))  # one key's log, which is written one entry at a time
    head = F.aggregate("rows", F.lit(GENESIS), lambda h, x: F.sha2(F.concat(h, x["payload"]), 256))
    return log.groupBy(*key).agg(rows.alias("rows")).select(*key, F.size("rows").cast("long").alias("n"), head.alias("head"))


def chain_faults(log: DataFrame, key: list[str]) -> DataFrame:
    """(key, seq, fault): entries out of sequence, off the stored hash before, or with another hash than their content's."""
    w = W.partitionBy(*key).orderBy("seq")
    seen = log.withColumns({"due": F.row_number().over(w), "before": F.lag("entry_hash", 1, GENESIS).over(w)})
    faults = F.array_compact(F.array(F.when(F.col("seq") != F.col("due"), "sequence"), F.when(F.col("prev_hash") != F.col("before"), "previous"), F.when(F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("entry_hash"), "content")))
    return seen.select(*key, "seq", F.explode(faults).alias("fault"))


def dependents(jobs: DataFrame, roots: Column) -> DataFrame:
    """(id, depth): the roots' jobs and all that depend on them, over (id, parent), with the least number of steps.

    Where each job has one parent at most, chains are followed by pointer doubling (pointers.chain_ends), so one of n steps
    takes about log2(n) rounds; else by a round for each step, until nothing is new. Chains may be of any length, and
    jobs may depend in circles. A job that depends on itself is as far from the roots as without that, and ends its chain:
    as a circle it would keep all that lead to it going for as many rounds as the table's size allows.
    """
    from .pointers import chain_ends

    first = written(jobs.where(roots).select("id").distinct())
    links = written(jobs.select("id", "parent").distinct())
    if links.groupBy("id").count().where("count > 1").isEmpty():
        own = links.join(first.withColumn("root", F.lit(True)), "id", "left")
        ends, _ = chain_ends(own.select("id", F.when(F.col("root").isNull() & (F.col("parent") != F.col("id")), F.col("parent")).alias("next")))
        return ends.join(first.select(F.col("id").alias("last")), "last", "left_semi").select("id", F.col("steps").alias("depth"))
    seen = frontier = first.withColumn("depth", F.lit(0).cast("long"))
    while not frontier.isEmpty():
        steps = frontier.select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"))
        reached = links.join(steps, "parent").select("id", "depth").distinct()
        frontier = written(reached.join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def rate_limited(events: DataFrame, key: list[str], window_us: int, most: int) -> DataFrame:
    """events with `recent`, those of the key in the window up to it, and whether that is `most` or more."""
    w = W.partitionBy(*key).orderBy("lo").rangeBetween(-window_us, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") >= most)


def permitted(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return rows.join(members.select(key), key, "left_semi")


def topology_faults(edges: DataFrame) -> DataFrame:
    """(x, y, fault): loops and pairs given more than once, in either direction; x <= y."""
    pair = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    counted = pair.groupBy("x", "y").agg(F.count("*").alias("n"))
    return counted.select("x", "y", F.when(F.col("x") == F.col("y"), "loop").when(F.col("n") > 1, "repeated").alias("fault")).where("fault is not null")


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet takes for a formula, quoted."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def recoverable_prefix(units: DataFrame, key: list[str], order: str) -> DataFrame:
    """units with `recoverable`: intact and so is every one before it in the key."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return units.withColumn("recoverable", F.min(F.col("intact").cast("int")).over(w) == 1)


def merge_bad_ranges(ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key, s, e, error): neighbours merge where one begins at the other's end with the same error."""
    from .intervals import islands

    w = W.partitionBy(*key).orderBy("s", "e", "error")
    joined = F.lag("e").over(w).eqNullSafe(F.col("s")) & F.lag("error").over(w).eqNullSafe(F.col("error"))
    marked = islands(ranges.withColumn("new", ~joined), key, ["s", "e", "error"], F.col("new"))
    return marked.groupBy(*key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("error").alias("error")).drop("island")
