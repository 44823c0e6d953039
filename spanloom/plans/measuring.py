"""Queries of the measuring operators, each with its oracle where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measuring
from . import bindings as b
from .catalog import QUERIES, query


@query("""SELECT user_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_samples, round(max(value), 6) AS peak, round(avg(value), 6) AS mean, round(min(frame) / 25.0, 6) AS start_s, round(max(frame) / 25.0, 6) AS end_s
FROM (SELECT *, sum(CASE WHEN n - p > 3 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS p
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id * 3 AS frame FROM events) t WHERE value > 20) u) v GROUP BY user_id, run HAVING count(*) >= 3""")
def motion_runs(spark: SparkSession, d: str) -> DataFrame:
    samples = b.table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), (F.col("event_id") * 3).alias("frame"), F.col("value").alias("score"), (F.col("value") > 20).alias("moving"))
    return measuring.motion_runs(samples, ["user_id"], 2, 3, 25.0)


_T = "b_t AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {v})" for k, v in measuring.T975.items()) + ") t(df, v))"


@query("""SELECT n AS df, round(CASE WHEN n > 120 THEN lo.v + (1.0 / n - 1.0 / 120) / (0 - 1.0 / 120) * (1.96 - lo.v) WHEN lo.df = n THEN lo.v ELSE lo.v + (1.0 / n - 1.0 / lo.df) / (1.0 / hi.df - 1.0 / lo.df) * (hi.v - lo.v) END, 6) AS t
FROM (SELECT DISTINCT CAST(p_size * 4 - 3 AS BIGINT) AS n FROM part) p JOIN b_t lo ON lo.df = (SELECT max(df) FROM b_t WHERE df <= p.n) LEFT JOIN b_t hi ON hi.df = (SELECT min(df) FROM b_t WHERE df >= p.n)""", _T)
def t_points(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "part").select((F.col("p_size").cast("long") * 4 - 3).alias("df")).distinct()
    return n.select("df", F.round(measuring.t_critical(F.col("df")), 6).alias("t"))


def clock_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a clock for each user, running 10 to 209 ppm fast; some are read at one time, some run back."""
    e = b.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    base = F.lit(1_704_067_200_000_000)
    device = F.when(F.col("user_id") % 11 == 3, base).otherwise(at)
    drift = F.floor((at - base) * (F.col("user_id") % 200 + 10) / 1_000_000) + F.floor(F.col("value")) * 10_000
    true = device + F.when(F.col("user_id") % 13 == 4, -2 * (at - base)).otherwise(drift)
    return e.select("user_id", device.alias("device_us"), true.alias("true_us"))


_CLOCK = f"""b_clock AS (SELECT user_id, CASE WHEN user_id % 11 = 3 THEN 1704067200000000 ELSE a END AS du, CASE WHEN user_id % 11 = 3 THEN 1704067200000000 ELSE a END
  + CASE WHEN user_id % 13 = 4 THEN -2 * (a - 1704067200000000) ELSE CAST(floor((a - 1704067200000000) * (user_id % 200 + 10) / 1000000) AS BIGINT) + CAST(floor(value) AS BIGINT) * 10000 END AS tu
  FROM (SELECT *, epoch_us(ts) AS a FROM events) t),
b_xy AS (SELECT user_id, (du - min(du) OVER p) / 1e6 AS x, (tu - du) / 1e6 AS y, coalesce(du > lag(du) OVER w AND tu <= lag(tu) OVER w, false) AS back FROM b_clock WINDOW p AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY du, tu)),
b_fit AS (SELECT user_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_syy(y, x) AS syy, regr_r2(y, x) AS r2, bool_or(back) AS back FROM b_xy GROUP BY user_id),
b_model AS (SELECT *, n = 1 OR sxx = 0 AS flat, CASE WHEN n = 1 OR sxx = 0 THEN n - 1 ELSE n - 2 END AS df FROM b_fit)"""


@query("""SELECT user_id, CASE WHEN flat THEN 'offset_only' ELSE 'linear' END AS method, n, round(CASE WHEN flat THEN my ELSE my - b * mx END, 4) AS offset_s, round(CASE WHEN flat THEN 0 ELSE b * 1e6 END, 3) AS drift_ppm,
round(CASE WHEN df < 1 THEN 2 / sqrt(3) ELSE greatest(2 / sqrt(3), sqrt(greatest(0, CASE WHEN flat THEN syy ELSE syy * (1 - coalesce(r2, 1)) END) / df)) END, 4) AS sigma_s, NOT back AND (flat OR abs(b * 1e6) < 10000) AS usable FROM b_model""", _CLOCK)
def drift_model(spark: SparkSession, d: str) -> DataFrame:
    m = measuring.drift_model(clock_readings(spark, d), ["user_id"], 2.0)
    return m.select("user_id", "method", "n", F.round("offset_s", 4).alias("offset_s"), F.round("drift_ppm", 3).alias("drift_ppm"), F.round("sigma_s", 4).alias("sigma_s"), "usable")


@query("""SELECT user_id, n, round(m, 6) AS middle, CASE WHEN n < 5 THEN 'unreadable' WHEN most <= 60 THEN 'pass' WHEN abs(m) > 60 THEN 'fail' ELSE 'inconclusive' END AS status
FROM (SELECT user_id, count(v) AS n, median(v) AS m, max(abs(v)) AS most FROM (SELECT user_id, CASE WHEN event_id % 4 <> 0 AND event_id % (user_id % 9 + 1) = 0 THEN value + (user_id % 3) * 40 - 40 END AS v FROM events) t GROUP BY user_id) u""")
def overlay_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Many readings can't be read."""
    r = b.table(spark, d, "events").select("user_id", F.when((F.col("event_id") % 4 != 0) & (F.col("event_id") % (F.col("user_id") % 9 + 1) == 0), F.col("value") + (F.col("user_id") % 3) * 40 - 40).alias("delta"))
    return measuring.overlay_verdict(r, ["user_id"], 60.0, 5).withColumn("middle", F.round("middle", 6))


_CLIPS = """b_est AS (SELECT o_orderkey AS id, o_orderkey % 9 = 0 AS orphan, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'decode_errors' WHEN 2 THEN 'export_failed' ELSE 'not_run' END AS ds,
  o_orderkey % 5 AS irap, o_orderstatus = 'F' AS joined, o_orderkey % 7 < 4 AS generic, o_orderkey % 2 = 1 AS validated, (o_totalprice % 1000) / 1000 AS actual FROM orders),
b_rule AS (SELECT *, CASE WHEN orphan THEN 0.0 WHEN ds = 'not_run' THEN NULL ELSE round(CASE ds WHEN 'ok' THEN 1.0 WHEN 'decode_errors' THEN 0.5 ELSE 0.0 END::DOUBLE * (CASE WHEN irap > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE
  * (CASE WHEN joined THEN 0.9 ELSE 1.0 END)::DOUBLE * (CASE WHEN (generic AND validated) OR ds = 'ok' THEN 1.0 ELSE 0.9 END)::DOUBLE, 4) END AS estimate FROM b_est)"""


def estimated_clips(spark: SparkSession, d: str) -> DataFrame:
    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(k % 4 == 0, "ok").when(k % 4 == 1, "decode_errors").when(k % 4 == 2, "export_failed").otherwise("not_run")
    clips = o.select(k.alias("id"), F.when(k % 9 == 0, "orphan").otherwise("clip").alias("kind"), status.alias("decode_status"), (k % 5).alias("irap_count"), (F.col("o_orderstatus") == "F").alias("reassembled"), F.when(k % 7 < 4, "generic").otherwise("vendor").alias("engine"), (k % 2 == 1).alias("validated"), (F.col("o_totalprice") % 1000 / 1000).alias("actual"))
    return measuring.recoverability(clips)


@query("SELECT id, estimate, estimate IS NOT NULL AS available, CASE WHEN estimate >= 0.9 THEN 'high' WHEN estimate >= 0.5 THEN 'medium' WHEN estimate IS NOT NULL THEN 'low' END AS band FROM b_rule", _CLIPS)
def recoverability(spark: SparkSession, d: str) -> DataFrame:
    return estimated_clips(spark, d).select("id", "estimate", "available", "band")


_BAND = "CASE WHEN {0} >= 0.9 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' ELSE 'low' END"


@query(f"""SELECT engine, count(*) AS n, round(corr(estimate, actual), 6) AS pearson, round(avg(abs(estimate - actual)), 6) AS mae, round(avg(estimate - actual), 6) AS signed,
round(avg(CASE WHEN {_BAND.format("estimate")} = {_BAND.format("actual")} THEN 1.0 ELSE 0.0 END), 6) AS same_band, round(corr(re, ra), 6) AS spearman
FROM (SELECT *, CASE WHEN generic THEN 'generic' ELSE 'vendor' END AS engine, rank() OVER (PARTITION BY generic ORDER BY estimate) + (count(*) OVER (PARTITION BY generic, estimate) - 1) / 2 AS re,
rank() OVER (PARTITION BY generic ORDER BY actual) + (count(*) OVER (PARTITION BY generic, actual) - 1) / 2 AS ra FROM b_rule WHERE estimate IS NOT NULL) t GROUP BY engine""", _CLIPS)
def estimate_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = measuring.agreement(estimated_clips(spark, d).where("available"), ["engine"], "estimate", "actual")
    return rows.select("engine", "n", *(F.round(c, 6).alias(c) for c in ("pearson", "mae", "signed", "same_band", "spearman")))


def bootstrap_rates(spark: SparkSession, d: str) -> DataFrame:
    """Resampled: no oracle; tests hold the interval against the binomial one."""
    counts = b.table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    return measuring.bootstrap(counts, ["o_orderpriority"], "o_custkey", "k", "n")


QUERIES["bootstrap_rates"] = bootstrap_rates


@query("""SELECT c.scenario, CAST(tp AS BIGINT) AS tp, CAST(carved AS BIGINT) AS carved, kinds FROM (SELECT o_orderpriority AS scenario, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS tp, count(*) AS carved FROM orders GROUP BY 1) c
JOIN (SELECT scenario, string_agg(name || '=' || n, ',' ORDER BY name) AS kinds FROM (SELECT o_orderpriority AS scenario, o_orderstatus AS name, count(*) + sum(o_orderkey % 2) AS n FROM orders GROUP BY 1, 2) t GROUP BY 1) k ON k.scenario = c.scenario""")
def counters_merged(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("scenario"), (F.col("o_orderstatus") == "F").cast("long").alias("tp"), F.lit(1).cast("long").alias("carved"), F.create_map("o_orderstatus", F.col("o_orderkey") % 2 + 1).alias("kinds"))
    out = measuring.merged_counters(rows, ["scenario"], ["tp", "carved"], "kinds")
    return out.withColumn("kinds", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


_COUNTS = "b_count AS (SELECT l_returnflag AS engine, l_linestatus AS scenario, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS tp, count(*) AS carved, CAST(sum(l_linenumber) AS BIGINT) AS truth, CAST(0 AS BIGINT) AS checked FROM lineitem GROUP BY 1, 2)"


def counters(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("scenario")).agg(F.count_if(F.col("l_discount") > 0.05).alias("tp"), F.count("*").alias("carved"), F.sum("l_linenumber").alias("truth"), F.lit(0).cast("long").alias("checked"))


@query("""SELECT engine, metric, k, n, CASE WHEN n > 0 THEN round(k / n, 4) END AS rate FROM (SELECT engine, unnest(['precision', 'recall', 'hash']) AS metric, unnest([tp, tp, tp]) AS k, unnest([carved, truth, checked]) AS n
FROM (SELECT engine, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(carved) AS BIGINT) AS carved, CAST(sum(truth) AS BIGINT) AS truth, CAST(sum(checked) AS BIGINT) AS checked FROM b_count GROUP BY engine) t) u""", _COUNTS)
def scenario_metrics(spark: SparkSession, d: str) -> DataFrame:
    return measuring.pooled_rates(counters(spark, d), ["engine"], {"precision": ("tp", "carved"), "recall": ("tp", "truth"), "hash": ("tp", "checked")})


@query("""SELECT engine, string_agg(scenario || '[' || rows || ']', ' ' ORDER BY scenario) AS cards FROM (SELECT engine, scenario, string_agg(metric || ':' || v, ',' ORDER BY metric) AS rows
FROM (SELECT engine, scenario, unnest(['carved', 'tp']) AS metric, unnest([carved, tp]) AS v FROM b_count) t GROUP BY 1, 2) u GROUP BY engine""", _COUNTS)
def scorecards(spark: SparkSession, d: str) -> DataFrame:
    metrics = counters(spark, d).select("engine", "scenario", F.inline(F.array(F.struct(F.lit("tp").alias("metric"), F.col("tp").alias("v")), F.struct(F.lit("carved").alias("metric"), F.col("carved").alias("v")))))
    cards = measuring.scorecards(metrics, "engine", "scenario", "metric", "v")
    row = lambda r: F.concat(r["metric"], F.lit(":"), r["v"].cast("string"))
    card = lambda c: F.concat(c["scenario"], F.lit("["), F.array_join(F.transform(c["rows"], row), ","), F.lit("]"))
    return cards.select("engine", F.array_join(F.transform("cards", card), " ").alias("cards"))


@query("""SELECT clip_id, string_agg(class_name || ': ' || n || CASE WHEN c IS NOT NULL THEN printf(' (max confidence %.2f)', c) ELSE '' END, '; ' ORDER BY class_name || ': ' || n) AS sentence
FROM (SELECT clip_id, class_name, count(*) AS n, max(round(confidence, 2)) AS c FROM b_event GROUP BY 1, 2) t GROUP BY clip_id""", b.EVENTS)
def summary_sentences(spark: SparkSession, d: str) -> DataFrame:
    groups = b.events(spark, d).groupBy("clip_id", "class_name").agg(F.count("*").alias("n"), F.max(measuring.rounded(F.col("confidence"), 2)).alias("c"))
    return measuring.sentences(groups, ["clip_id"], "class_name", "n", "c")


@query("""SELECT o_custkey AS case_id, o_orderpriority AS task, round(1000000 - sum(o_totalprice), 2) AS saved, CASE WHEN sum(o_totalprice) > 0 THEN round(1000000 / sum(o_totalprice), 4) END AS speedup FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def time_saved(spark: SparkSession, d: str) -> DataFrame:
    """Against a baseline of a million seconds for each task of a case."""
    tool = b.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("task")).agg(F.sum("o_totalprice").alias("s"))
    return tool.select("case_id", "task", F.round(F.lit(1_000_000) - F.col("s"), 2).alias("saved"), F.when(F.col("s") > 0, F.round(F.lit(1_000_000) / F.col("s"), 4)).alias("speedup"))
