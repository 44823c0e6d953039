"""Every registered query by name, with its oracle where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, records, scoring, timeline
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY, HOUR, SECOND = timeline.DAY, 3_600_000_000, 1_000_000
WIDTH = 1024


def query(oracle: str, *views: str) -> Callable[[Query], Query]:
    """Register a query under its own name; the oracle's views go before its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + oracle
        return f

    return register


HIT = ["id", "class_name", "channel", "clip_id", "lo", "confidence"]


@query("SELECT id, class_name, channel, clip_id, lo, confidence FROM b_event WHERE class_name IN ('click', 'purchase') AND channel IN (1, 2) AND confidence IS NOT NULL AND confidence >= 0.3 AND placement = 'placed'", b.EVENTS)
def event_search_basic(spark: SparkSession, d: str) -> DataFrame:
    what = timeline.EventFilter(("click", "purchase"), (1, 2), (), (">=", 0.3), "placed")
    return timeline.search(b.events(spark, d), what).select(HIT)


@query("SELECT id, class_name, channel, clip_id, lo, confidence FROM b_event WHERE confidence IS NOT NULL AND confidence <> 0.5 ORDER BY lo NULLS LAST, clip_id, id LIMIT 100 OFFSET 50", b.EVENTS)
def event_search_page(spark: SparkSession, d: str) -> DataFrame:
    return timeline.search(b.events(spark, d), timeline.EventFilter(confidence=("!=", 0.5)), 50, 100).select(HIT)


_TOD = """SELECT id, CASE WHEN bool_or(lo >= day * 86400000000 + 79200000000 AND hi <= day * 86400000000 + 93600000000) THEN 'within' ELSE 'overlaps_boundary' END AS verdict
FROM (SELECT id, lo, hi, unnest(range(lo // 86400000000 - 1, hi // 86400000000 + 1)) AS day FROM b_event WHERE lo IS NOT NULL) t
WHERE lo <= day * 86400000000 + 93600000000 AND hi >= day * 86400000000 + 79200000000 GROUP BY id"""


@query(_TOD, b.EVENTS)
def event_search_daily_window(spark: SparkSession, d: str) -> DataFrame:
    """From 22:00 to 02:00."""
    verdict = timeline.in_daily_window(F.col("lo"), F.col("hi"), 22 * HOUR, 2 * HOUR)
    return b.events(spark, d).where("lo is not null").select("id", verdict.alias("verdict")).where("verdict is not null")


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'with')")
def event_search_terms(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").where(timeline.EventFilter(terms=("the", "With")).predicate()).select("doc_id")


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS BIGINT) AS n_terms, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS BIGINT) AS n_distinct FROM documents")
def term_index(spark: SparkSession, d: str) -> DataFrame:
    terms = timeline.tokens(F.col("text"))
    return b.table(spark, d, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.size(F.array_distinct(terms)).cast("long").alias("n_distinct"))


@query("SELECT evidence_id, count(*) AS n, string_agg(DISTINCT CAST(clip_id AS VARCHAR), ',' ORDER BY CAST(clip_id AS VARCHAR)) AS clips FROM b_event WHERE placement = 'unplaceable' GROUP BY 1", b.EVENTS)
def event_excluded_clips(spark: SparkSession, d: str) -> DataFrame:
    out = b.events(spark, d).where("placement = 'unplaceable'")
    return out.groupBy("evidence_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("clip_id").cast("string"))), ",").alias("clips"))


_SUMMARY = "count(*) AS n, count(DISTINCT clip_id) AS clips, count(lo) AS placed, min(lo) AS first_lo, max(\"end\") AS last_end, max(confidence) AS best FROM b_event GROUP BY ALL"


def _summary(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key, "class_name").agg(F.count("*").alias("n"), F.countDistinct("clip_id").alias("clips"), F.count("lo").alias("placed"), F.min("lo").alias("first_lo"), F.max("end").alias("last_end"), F.max("confidence").alias("best"))


@query(f"SELECT clip_id, class_name, {_SUMMARY}", b.EVENTS)
def event_summary_clip(spark: SparkSession, d: str) -> DataFrame:
    return _summary(b.events(spark, d), ["clip_id"])


@query(f"SELECT evidence_id, channel, class_name, {_SUMMARY}", b.EVENTS)
def event_summary_camera(spark: SparkSession, d: str) -> DataFrame:
    return _summary(b.events(spark, d), ["evidence_id", "channel"])


_SEGMENTS = """b_reach AS (SELECT *, max("end") OVER (PARTITION BY clip_id, class_name ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b_event WHERE lo IS NOT NULL),
b_mark AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo - reach > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, class_name ORDER BY lo, id ROWS UNBOUNDED PRECEDING) AS island FROM b_reach),
b_segment AS (SELECT clip_id, class_name, min(lo) AS start, max("end") AS "end", count(*) AS n FROM b_mark GROUP BY clip_id, class_name, island)"""


@query('SELECT clip_id, class_name, start, "end", n FROM b_segment', b.EVENTS, _SEGMENTS)
def segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sessions(b.events(spark, d), ["clip_id", "class_name"], DAY)


def _camera_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.sessions(b.events(spark, d), ["clip_id", "class_name"], DAY)
    return rows.select(F.concat_ws(":", "clip_id", "class_name", "start").alias("id"), (F.col("clip_id") % 4).alias("camera"), "class_name", "start", "end")


_LINKS = """b_side AS (SELECT clip_id || ':' || class_name || ':' || start AS id, clip_id % 4 AS camera, class_name, start, "end" FROM b_segment),
b_sym AS (SELECT x, y FROM b_edge WHERE x <> y UNION SELECT y, x FROM b_edge WHERE x <> y),
b_link AS (SELECT a.id AS a, b.id AS b, a.class_name, greatest(0, b.start - a."end", a.start - b."end") AS least, greatest(b."end" - a.start, a."end" - b.start) AS most FROM b_side a JOIN b_sym ON x = a.camera JOIN b_side b ON b.camera = y AND a.class_name = b.class_name AND a.id < b.id)"""


@query("SELECT a, b, class_name, least, most FROM b_link WHERE least <= 600000000", b.EVENTS, _SEGMENTS, b.EDGE_ROWS, _LINKS)
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    return timeline.link_candidates(_camera_segments(spark, d), b.edges(spark), 600 * SECOND)


@query("""SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN NOT has_old THEN 'insert' WHEN o_orderstatus <> 'O' THEN 'keep' WHEN NOT has_new THEN 'delete' ELSE 'update' END AS action
FROM (SELECT *, o_orderkey % 3 <> 0 AS has_old, o_orderkey % 4 <> 0 AS has_new FROM orders) t WHERE has_old OR has_new""")
def link_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.when(F.col("o_orderstatus") == "O", "suggested").otherwise("decided").alias("status"))
    return timeline.reconcile(o.where("b % 3 <> 0"), o.where("b % 4 <> 0"), ["a", "b"])


_ORDER = 'row_number() OVER (PARTITION BY evidence_id ORDER BY lo, "end", channel IS NULL, channel, clip_id, id) AS place FROM b_event WHERE lo IS NOT NULL'


@query(f"SELECT evidence_id, id, {_ORDER}", b.EVENTS)
def timeline_order(spark: SparkSession, d: str) -> DataFrame:
    return timeline.presentation_order(b.events(spark, d), ["evidence_id"]).select("evidence_id", "id", "place")


@query("""SELECT evidence_id, channel, a, b, gap, least, most, least > 0 AS certain FROM (SELECT evidence_id, channel, id AS a, lead(id) OVER w AS b, lead(lo) OVER w - "end" AS gap, lead(lo) OVER w - "end" - (hi - lo) AS least, lead(hi) OVER w - "end" AS most
FROM b_event WHERE lo IS NOT NULL WINDOW w AS (PARTITION BY evidence_id, channel ORDER BY lo, "end", id)) t WHERE gap > 60000000""", b.EVENTS)
def timeline_gaps(spark: SparkSession, d: str) -> DataFrame:
    return timeline.gaps(b.events(spark, d), ["evidence_id", "channel"], 60 * SECOND)


@query("""SELECT x.class_name, x.id AS a, y.id AS b, greatest(x.lo, y.lo) AS s, least(x."end", y."end") AS e FROM b_event x JOIN b_event y ON x.class_name = y.class_name AND (x.lo, x."end", x.id) < (y.lo, y."end", y.id)
AND greatest(x.lo, y.lo) < least(x."end", y."end") WHERE x.lo < x."end" AND y.lo < y."end" """, b.EVENTS)
def timeline_overlaps(spark: SparkSession, d: str) -> DataFrame:
    e = b.events(spark, d).where("lo is not null")
    return intervals.overlap_pairs(e, ["class_name"], 120 * SECOND, "id", "lo", "end")


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS seconds, CAST(second(ts) + 64 * minute(ts) + 4096 * hour(ts) + 131072 * day(ts) + 4194304 * month(ts) + 67108864 * (year(ts) - 2000) AS BIGINT) AS raw FROM events""")
def packed_datetime(spark: SparkSession, d: str) -> DataFrame:
    raw = timeline.pack_datetime(F.col("ts"))
    return b.table(spark, d, "events").select("event_id", timeline.unpack_datetime(raw).cast("long").alias("seconds"), raw.alias("raw"))


_LOCAL = """SELECT id, CAST(count(c) AS INT) AS n, min(epoch_us(c)) AS first_us, max(epoch_us(c)) AS last_us FROM (SELECT DISTINCT id, w, CASE WHEN timezone('UTC', timezone('Europe/Berlin', timezone('UTC', w - INTERVAL (k) MINUTE))) = w OR timezone('Europe/Berlin', timezone('UTC', w - INTERVAL (k) MINUTE)) = w THEN w - INTERVAL (k) MINUTE END AS c
FROM (SELECT id, TIMESTAMP '2024-03-30 00:30:00' + INTERVAL (id % 48) HOUR + INTERVAL (CASE WHEN id % 2 = 0 THEN 0 ELSE 210 * 24 END) HOUR AS w FROM b_event) t, (VALUES (60), (120)) z(k)) u GROUP BY id"""


@query(_LOCAL, b.EVENTS)
def localize_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Wall clocks about both changes of summer time in 2024."""
    hours = F.col("id") % 48 + F.when(F.col("id") % 2 == 0, 0).otherwise(210 * 24)
    wall = F.timestamp_micros(F.lit(1711758600 * SECOND) + hours * HOUR)
    c = timeline.candidates(wall, "Europe/Berlin")
    us = lambda x: F.unix_micros(x)
    return b.events(spark, d).select("id", c.alias("c")).select("id", F.size("c").alias("n"), us(F.array_min("c")).alias("first_us"), us(F.array_max("c")).alias("last_us"))


@query("""SELECT clip_id, count(*) AS n, round(coalesce(regr_slope(value, x), 0), 6) AS slope, round(coalesce(regr_intercept(value, x), avg(value)), 6) AS intercept FROM (SELECT clip_id, value, ("at" - 1704067200000000) / 86400000000.0 AS x FROM b_event) t GROUP BY clip_id""", b.EVENTS)
def drift_fit(spark: SparkSession, d: str) -> DataFrame:
    o = b.events(spark, d).select("clip_id", F.col("value").alias("y"), ((F.col("at") - 1704067200 * SECOND) / F.lit(float(DAY))).alias("x"))
    return timeline.drift_fit(o, ["clip_id"]).select("clip_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


_MERGED = """b_sreach AS (SELECT *, max(e) OVER (PARTITION BY img ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b_span WHERE s < e),
b_smark AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY img ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b_sreach),
b_merged AS (SELECT img, min(s) AS s, max(e) AS e FROM b_smark GROUP BY img, island)"""


@query("SELECT img, s, e FROM b_merged", b.SPANS, _MERGED)
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_spans(b.spans(spark, d), ["img"])


@query("SELECT img, s, e FROM (SELECT img, lag(e, 1, 0) OVER (PARTITION BY img ORDER BY s, e) AS s, s AS e FROM (SELECT img, s, e FROM b_merged UNION ALL SELECT img, max(e) + 4096, max(e) + 4096 FROM b_span GROUP BY img) t) u WHERE s < e", b.SPANS, _MERGED)
def span_complement(spark: SparkSession, d: str) -> DataFrame:
    return intervals.complement_spans(intervals.merge_spans(b.spans(spark, d), ["img"]), b.sizes(spark, d), ["img"])


_REGIONS = """b_edge0 AS (SELECT DISTINCT img, pos FROM (SELECT img, s AS pos FROM b_span WHERE s < e UNION ALL SELECT img, e FROM b_span WHERE s < e) t),
b_step AS (SELECT img, pos, lead(pos) OVER (PARTITION BY img ORDER BY pos) AS nxt FROM b_edge0),
b_cover AS (SELECT t.img, t.pos, t.nxt, min(rank) AS rank FROM b_step t JOIN b_span p ON p.img = t.img AND p.s <= t.pos AND t.nxt <= p.e GROUP BY ALL)"""


@query("SELECT img, rank, CAST(sum(nxt - pos) AS BIGINT) AS bytes FROM b_cover GROUP BY img, rank", b.SPANS, _REGIONS)
def region_summary(spark: SparkSession, d: str) -> DataFrame:
    regions = intervals.label_by_precedence(b.spans(spark, d), ["img"])
    return regions.groupBy("img", "rank").agg(F.sum(F.col("e") - F.col("s")).alias("bytes"))


_SIDES = "x.id AS l, y.id AS r, least(x.e, y.e) - greatest(x.s, y.s) AS overlap"


@query(f"SELECT img, l, r, overlap FROM (SELECT x.img, {_SIDES}, row_number() OVER (PARTITION BY x.img, x.id ORDER BY least(x.e, y.e) - greatest(x.s, y.s) DESC, y.s, y.id) AS k FROM b_span x JOIN b_span y ON x.img = y.img AND x.kind = 'A' AND y.kind = 'R' AND greatest(x.s, y.s) < least(x.e, y.e)) t WHERE k = 1", b.SPANS)
def argmax_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = b.spans(spark, d)
    return intervals.best_overlap(s.where("kind = 'A'"), s.where("kind = 'R'"), ["img"], WIDTH)


@query("SELECT img, id FROM b_span x WHERE kind = 'A' AND s < e AND NOT EXISTS (SELECT 1 FROM b_span y WHERE y.kind = 'R' AND y.img = x.img AND greatest(x.s, y.s) < least(x.e, y.e))", b.SPANS)
def unexplained_spans(spark: SparkSession, d: str) -> DataFrame:
    s = b.spans(spark, d)
    best = intervals.best_overlap(s.where("kind = 'A'"), s.where("kind = 'R'"), ["img"], WIDTH)
    return s.where("kind = 'A' and s < e").join(best.select("img", F.col("l").alias("id")), ["img", "id"], "left_anti").select("img", "id")


@query("SELECT case_id, id, status, kind FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id DESC) AS k FROM b_run) t WHERE k = 1", b.RUNS)
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return scoring.latest(b.runs(spark, d), ["case_id"], "id", ["status", "kind"])


@query("SELECT kind, count(*) AS n, count(*) FILTER (status = 'completed') AS k, round(count(*) FILTER (status = 'completed') / count(*), 6) AS rate FROM b_run GROUP BY kind", b.RUNS)
def success_rates(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rates(b.runs(spark, d), ["kind"], F.col("status") == "completed").select("kind", "n", "k", F.round("rate", 6).alias("rate"))


_RATE = """SELECT source, n, k, round(greatest(0.0, (k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS low,
round(least(1.0, (k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS high
FROM (SELECT source, count(*) AS n, count(*) FILTER (quality = predicted) AS k, 1.959963984540054::DOUBLE AS z FROM b_score GROUP BY source) t"""


@query(_RATE, b.SCORES)
def wilson_rates(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rates(b.scores(spark, d), ["source"], F.col("quality") == F.col("predicted")).select("source", "n", "k", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT source, CASE WHEN k / n < 0.5 THEN 'below' ELSE 'ok' END AS verdict FROM (SELECT source, count(*) AS n, count(*) FILTER (quality = predicted) AS k FROM b_score GROUP BY source) t UNION ALL SELECT 'nowhere', 'missing'", b.SCORES)
def threshold_check(spark: SparkSession, d: str) -> DataFrame:
    metrics = scoring.rates(b.scores(spark, d), ["source"], F.col("quality") == F.col("predicted")).withColumnRenamed("rate", "value")
    rules = metrics.select("source").unionByName(spark.createDataFrame([("nowhere",)], "source string")).withColumn("least", F.lit(0.5))
    return scoring.missed_thresholds(metrics, rules, "source")


_STAGE_ROWS = "b_rows AS (SELECT run, total, unnest(['scan', 'parse', 'carve', 'other']) AS stage, unnest([0, 1, 2, 3]) AS pos, unnest([scan, parse, carve, greatest(0.0, total - scan - parse - carve)]) AS seconds FROM b_stage)"


@query("SELECT run, stage, seconds, round(CASE WHEN total > 0 THEN seconds / total END, 6) AS share FROM b_rows", b.STAGES, _STAGE_ROWS)
def stage_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return scoring.stage_breakdown(b.stage_times(spark, d), ["run"], ["scan", "parse", "carve"], "total").select("run", "stage", "seconds", F.round("share", 6).alias("share"))


@query("SELECT run, stage, seconds / total >= 0.5 AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seconds DESC, pos) AS k FROM b_rows WHERE total >= 0.05) t WHERE k = 1", b.STAGES, _STAGE_ROWS)
def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bottleneck(scoring.stage_breakdown(b.stage_times(spark, d), ["run"], ["scan", "parse", "carve"], "total"), ["run"])


@query("SELECT case_id, kind, id, n, round(seconds - base, 4) AS delta, round(CASE WHEN base <> 0 THEN seconds / base END, 6) AS ratio FROM (SELECT *, count(*) OVER (PARTITION BY case_id, kind) AS n, first_value(seconds) OVER (PARTITION BY case_id, kind ORDER BY started, id) AS base FROM b_run) t WHERE n >= 2", b.RUNS)
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.against_first(b.runs(spark, d), ["case_id", "kind"], ["started", "id"], "seconds")
    return rows.select("case_id", "kind", "id", "n", F.round("delta", 4).alias("delta"), F.round("ratio", 6).alias("ratio"))


@query("""SELECT source, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM (SELECT source,
rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2 AS rx, rank() OVER (PARTITION BY source ORDER BY quality) + (count(*) OVER (PARTITION BY source, quality) - 1) / 2 AS ry FROM b_score) t GROUP BY source""", b.SCORES)
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return scoring.spearman(b.scores(spark, d), ["source"], "n_chars", "quality").select("source", "n", F.round("rho", 6).alias("rho"))


@query("""SELECT class_name, round(middle, 6) AS middle, round(mad, 6) AS mad, count(*) AS n, count(*) FILTER (abs(value - middle) > greatest(3 * 1.4826 * mad, 1.0)) AS outliers
FROM (SELECT *, median(abs(value - middle)) OVER (PARTITION BY class_name) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY class_name) AS middle FROM b_event) t) u GROUP BY class_name, middle, mad""", b.EVENTS)
def robust_deltas(spark: SparkSession, d: str) -> DataFrame:
    return scoring.robust_outliers(b.events(spark, d), ["class_name"], "value").select("class_name", F.round("middle", 6).alias("middle"), F.round("mad", 6).alias("mad"), "n", "outliers")


@query("SELECT class_name, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' ELSE 'unknown' END AS band, count(*) AS n FROM b_event GROUP BY 1, 2", b.EVENTS)
def counts_by_band(spark: SparkSession, d: str) -> DataFrame:
    return b.events(spark, d).groupBy("class_name", scoring.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


_FOLD = f"""b_fold AS (SELECT case_id, seq, sha256('{records.GENESIS}' || payload) AS h FROM b_log WHERE seq = 1 UNION ALL SELECT l.case_id, l.seq, sha256(f.h || l.payload) FROM b_fold f JOIN b_log l ON l.case_id = f.case_id AND l.seq = f.seq + 1)"""


@query("SELECT case_id, count(*) AS n, max_by(h, seq) AS head FROM b_fold GROUP BY case_id", b.LOG, _FOLD)
def chain_head(spark: SparkSession, d: str) -> DataFrame:
    return records.chain_heads(b.log(spark, d), ["case_id"])


_SPOILT = f"""b_written AS (SELECT f.case_id, f.seq, f.h, coalesce(lag(f.h) OVER w, '{records.GENESIS}') AS prev, l.payload || CASE WHEN order_id % 97 = 0 THEN '!' ELSE '' END AS payload, order_id FROM b_fold f JOIN b_log l USING (case_id, seq) WINDOW w AS (PARTITION BY f.case_id ORDER BY f.seq)),
b_kept AS (SELECT *, row_number() OVER w AS due, coalesce(lag(h) OVER w, '{records.GENESIS}') AS before FROM b_written WHERE order_id % 89 <> 0 WINDOW w AS (PARTITION BY case_id ORDER BY seq))"""


@query("""SELECT case_id, seq, 'sequence' AS fault FROM b_kept WHERE seq <> due UNION ALL SELECT case_id, seq, 'previous' FROM b_kept WHERE prev <> before
UNION ALL SELECT case_id, seq, 'content' FROM b_kept WHERE sha256(prev || payload) <> h""", b.LOG, _FOLD, _SPOILT)
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Logs whose every 97th order has got another payload since it was written, and every 89th has been taken out."""
    log = b.log(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("seq", "payload", "order_id")))
    start = F.array(F.struct(F.lit(records.GENESIS).alias("h"), F.lit(0).alias("seq"), F.lit("").alias("payload"), F.lit(0).cast("long").alias("order_id"), F.lit("").alias("prev")))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(F.sha2(F.concat(F.element_at(acc, -1)["h"], x["payload"]), 256).alias("h"), x["seq"].alias("seq"), x["payload"].alias("payload"), x["order_id"].alias("order_id"), F.element_at(acc, -1)["h"].alias("prev"))))
    written = log.groupBy("case_id").agg(rows.alias("rows")).select("case_id", F.inline(F.aggregate("rows", start, step))).where("seq > 0")
    spoilt = F.when(F.col("order_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    written = written.where("order_id % 89 <> 0")
    return records.chain_faults(written.select("case_id", "seq", spoilt.alias("payload"), F.col("prev").alias("prev_hash"), F.col("h").alias("entry_hash")), ["case_id"])


@query("SELECT id, min(depth) AS depth FROM b_down GROUP BY id", "b_job AS (SELECT o_orderkey AS id, o_orderkey // 2 AS parent FROM orders)", "b_down AS (SELECT id, 0::BIGINT AS depth FROM b_job WHERE id % 1000 = 7 UNION ALL SELECT j.id, d.depth + 1 FROM b_job j JOIN b_down d ON j.parent = d.id)")
def job_dependents(spark: SparkSession, d: str) -> DataFrame:
    jobs = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 2").alias("parent"))
    return records.dependents(jobs, F.col("id") % 1000 == 7)


@query("SELECT kind, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, bool_and(status <> 'running') AS done, count(DISTINCT case_id) AS cases FROM b_run GROUP BY kind", b.RUNS)
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    return b.runs(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(is_("completed")).alias("completed"), F.count_if(is_("failed")).alias("failed"), F.bool_and(~is_("running")).alias("done"), F.countDistinct("case_id").alias("cases"))


@query("""SELECT id, recent, recent >= 2 AS limited FROM (SELECT id, count(*) OVER (PARTITION BY clip_id ORDER BY "at" RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM b_event WHERE class_name = 'error') t""", b.EVENTS)
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    failures = b.events(spark, d).where("class_name = 'error'").select("id", "clip_id", F.col("at").alias("lo"))
    return records.rate_limited(failures, ["clip_id"], DAY, 2).select("id", "recent", "limited")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def access_filter(spark: SparkSession, d: str) -> DataFrame:
    members = b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.permitted(b.table(spark, d, "orders"), members, "o_custkey").select("o_orderkey")


@query("SELECT x, y, fault FROM (SELECT least(x, y) AS x, greatest(x, y) AS y, CASE WHEN least(x, y) = greatest(x, y) THEN 'loop' WHEN count(*) > 1 THEN 'repeated' END AS fault FROM b_edge GROUP BY 1, 2) t WHERE fault IS NOT NULL", b.EDGE_ROWS)
def topology_faults(spark: SparkSession, d: str) -> DataFrame:
    return records.topology_faults(b.edges(spark))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || text AS t FROM documents) u")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.expr("case doc_id % 4 when 0 then '=' when 1 then '-' when 2 then '@' else '' end"), "text")
    return b.table(spark, d, "documents").select("doc_id", records.csv_safe(cell).alias("cell"))


@query("SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM b_event", b.EVENTS)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return b.events(spark, d).select("id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, event_id, min(CASE WHEN value < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS recoverable FROM events")
def recoverable_prefix(spark: SparkSession, d: str) -> DataFrame:
    units = b.table(spark, d, "events").select("user_id", "event_id", (F.col("value") < 60).alias("intact"))
    return records.recoverable_prefix(units, ["user_id"], "event_id").select("user_id", "event_id", "recoverable")


_BAD = "b_bad AS (SELECT l_suppkey AS img, l_partkey // 4 * 512 AS s, l_partkey // 4 * 512 + 512 AS e, min(l_returnflag) AS error FROM lineitem GROUP BY 1, 2, 3)"


@query("""SELECT img, min(s) AS s, max(e) AS e, min(error) AS error FROM (SELECT *, sum(CASE WHEN pe = s AND perr = error THEN 0 ELSE 1 END) OVER (PARTITION BY img ORDER BY s, e, error ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, lag(e) OVER w AS pe, lag(error) OVER w AS perr FROM b_bad WINDOW w AS (PARTITION BY img ORDER BY s, e, error)) t) u GROUP BY img, island""", _BAD)
def bad_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("l_partkey div 4 * 512")
    rows = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("img"), s.alias("s"), (s + 512).alias("e")).agg(F.min("l_returnflag").alias("error"))
    return records.merge_bad_ranges(rows, ["img"])
