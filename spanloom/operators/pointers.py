"""Pointer doubling over functional graphs (each node leads to one other at most): ends of chains, reachable nodes, in log rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, written


def chain_ends(links: DataFrame, node: str = "id", to: str = "next") -> tuple[DataFrame, int]:
    """(node, last, steps, circular), and the rounds taken: where each node's chain ends.

    links has a row for each node; a null `to`, or one that is no node, ends a chain. Steps double from round to round,
    so a chain of n nodes takes about log2(n) rounds. Nodes that lie on a circle or lead into one are circular and have
    no last. Nodes that have come to an end take no part in later rounds.
    """
    nodes = links.select(F.col(node).alias("n"), F.col(to).alias("t"))
    known = nodes.select(F.col("n").alias("k"))
    first = nodes.join(known, F.col("t") == F.col("k"), "left").select("n", F.coalesce("k", "n").alias("at"), F.col("k").isNotNull().cast("long").alias("steps"))
    state = written(first)
    size, rounds = state.count(), 0
    ended = written(state.where("steps = 0").select("n"))
    while (1 << rounds) <= 2 * size:
        rounds += 1
        step = state.select(F.col("n").alias("m"), F.col("at").alias("far"), F.col("steps").alias("more"))
        going = state.join(ended.select(F.col("n").alias("e")), F.col("at") == F.col("e"), "left_anti")
        if going.isEmpty():
            break
        moved = going.join(step, F.col("at") == F.col("m")).select("n", F.col("far").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        new = written(state.join(going.select("n"), "n", "left_anti").unionByName(moved))
        removed(state)
        state = new
    out = state.join(ended.select(F.col("n").alias("e")), F.col("at") == F.col("e"), "left")
    circular = F.col("e").isNull()
    return out.select(F.col("n").alias(node), F.when(~circular, F.col("at")).alias("last"), F.when(~circular, F.col("steps")).alias("steps"), circular.alias("circular")), rounds


def reachable(links: DataFrame, roots: DataFrame, node: str = "id", to: str = "next") -> tuple[DataFrame, int]:
    """(node): the roots and every node that a chain from one leads to, and the rounds taken.

    Each round follows links twice as long from everything reached so far.
    """
    jump = written(links.where(F.col(to).isNotNull()).select(F.col(node).alias("n"), F.col(to).alias("t")))
    seen = written(roots.select(F.col(node).alias("n")).distinct())
    count, rounds = seen.count(), 0
    while True:
        rounds += 1
        more = written(seen.unionByName(seen.join(jump, "n").select(F.col("t").alias("n"))).distinct())
        now = more.count()
        removed(seen)
        seen = more
        if now == count:
            return seen.select(F.col("n").alias(node)), rounds
        count = now
        longer = written(jump.join(jump.select(F.col("n").alias("t"), F.col("t").alias("u")), "t").select("n", F.col("u").alias("t")))
        removed(jump)
        jump = longer


def latest_attempts(jobs: DataFrame, node: str = "id", retry_of: str = "retry_of") -> DataFrame:
    """(id, latest, attempts, circular): the end of each job's chain of retries; of several retries of a job the greatest id counts."""
    nxt = jobs.where(F.col(retry_of).isNotNull()).groupBy(F.col(retry_of).alias("_of")).agg(F.max(node).alias("next"))
    links = jobs.select(node).distinct().join(nxt, F.col(node) == F.col("_of"), "left").select(node, "next")
    ends, _ = chain_ends(links, node, "next")
    return ends.select(node, F.col("last").alias("latest"), F.col("steps").alias("attempts"), "circular")
