"""Adapters that give the star-schema tables the columns the operators ask for, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls brought in: channels, confidences and, of unplaceable ones, instants."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    placed = F.col("user_id") % 5 != 0
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("class_name"), F.when(F.col("user_id") % 17 != 0, F.col("user_id") % 4).alias("channel"), F.col("user_id").alias("clip_id"), (F.col("user_id") % 8).alias("evidence_id"),
        F.when(placed, us).alias("lo"), F.when(placed, us + 1_000_000).alias("hi"), F.when(placed, us + F.floor("value") * 1_000_000).alias("end"), us.alias("at"),
        F.when(F.col("event_type") != "signup", F.least(F.col("value") / 100, F.lit(1.0))).alias("confidence"), F.when(placed, "placed").otherwise("unplaceable").alias("placement"), "value", "props",
    )


EVENTS = """b_event AS (SELECT event_id AS id, event_type AS class_name, CASE WHEN user_id % 17 <> 0 THEN user_id % 4 END AS channel, user_id AS clip_id, user_id % 8 AS evidence_id,
  CASE WHEN user_id % 5 <> 0 THEN epoch_us(ts) END AS lo, CASE WHEN user_id % 5 <> 0 THEN epoch_us(ts) + 1000000 END AS hi,
  CASE WHEN user_id % 5 <> 0 THEN epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 END AS "end", epoch_us(ts) AS "at",
  CASE WHEN event_type <> 'signup' THEN least(value / 100, 1.0) END AS confidence, CASE WHEN user_id % 5 <> 0 THEN 'placed' ELSE 'unplaceable' END AS placement, value, props FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_partkey") * 64
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 64 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 100 + F.floor("l_quantity")).alias("id"), F.col("l_suppkey").alias("img"), s.alias("s"), (s + F.floor("l_quantity") * 16).alias("e"), F.col("l_returnflag").alias("kind"), F.expr("case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end").alias("rank"))


SPANS = "b_span AS (SELECT (l_orderkey * 64 + l_linenumber) * 100000000 + l_partkey * 100 + CAST(floor(l_quantity) AS BIGINT) AS id, l_suppkey AS img, l_partkey * 64 AS s, l_partkey * 64 + CAST(floor(l_quantity) AS BIGINT) * 16 AS e, l_returnflag AS kind, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank FROM lineitem)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image ends 4096 bytes beyond its last span."""
    return spans(spark, sf_dir).groupBy("img").agg((F.max("e") + 4096).alias("size"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash-chained log for each customer, its hashes stored; every 97th order's hash is spoilt."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    seq = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    payload = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return o.select(F.col("o_custkey").alias("case_id"), seq.alias("seq"), payload.alias("payload"), F.col("o_orderkey").alias("order_id"))


LOG = "b_log AS (SELECT o_custkey AS case_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq, o_orderkey || '|' || o_orderstatus AS payload, o_orderkey AS order_id FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), status.alias("status"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("seconds"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("started"))


RUNS = "b_run AS (SELECT o_orderkey AS id, o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderpriority AS kind, o_totalprice AS seconds, epoch_us(o_orderdate) AS started FROM orders)"


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds, so that sums are exact: quantity, tax and discount cents of an order, in a total one fifth above."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.sum(F.floor("l_quantity")).cast("double").alias("scan"), cents("l_tax").alias("parse"), cents("l_discount").alias("carve"))
    return own.withColumn("total", F.floor((F.col("scan") + F.col("parse") + F.col("carve")) * 6 / 5).cast("double"))


STAGES = "b_stage0 AS (SELECT l_orderkey AS run, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS DOUBLE) AS scan, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS parse, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS carve FROM lineitem GROUP BY 1), b_stage AS (SELECT *, floor((scan + parse + carve) * 6 / 5) AS total FROM b_stage0)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("predicted", (F.col("n_chars") >= 1000).cast("int"))


SCORES = "b_score AS (SELECT d.doc_id, source, n_chars, quality, CAST(n_chars >= 1000 AS INT) AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
EDGES = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 3)]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "x long, y long")


EDGE_ROWS = "b_edge AS (SELECT * FROM (VALUES " + ", ".join(f"({x}::BIGINT, {y}::BIGINT)" for x, y in EDGES) + ") t(x, y))"
