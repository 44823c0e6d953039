"""Queries of timestamp decoding, placement and the event index, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import placement, timeline
from . import bindings as b
from .catalog import SECOND, query

#: 30 March 2024, 00:30, the first of 48 hours about a change of summer time; 210 days later comes the other one.
BASE = 1_711_758_600
ZONES = ("Europe/Berlin", "UTC", "Mars/Base")


def raw_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """An event's packed date, epoch or other value, with impossible, wrapped and overflown ones; zones known, unknown and null."""
    i, user = F.col("event_id"), F.col("user_id")
    sec = F.lit(BASE) + (i % 48) * 3600 + (i % 2) * (210 * 86400)
    packed = timeline.pack_datetime(F.timestamp_seconds(sec))
    raw = F.when(i % 5 == 0, F.when(i % 50 == 0, packed.bitwiseAND(~(15 << 22))).otherwise(packed)).when(i % 5 == 2, sec * SECOND).when(i % 5 == 4, F.lit(1 << 31) + i * 500_000).otherwise(sec)
    form = F.element_at(F.array(*(F.lit(x) for x in ("dhav", "unix_s", "unix_us", "other", "unix_s"))), (i % 5 + 1).cast("int"))
    zone = F.when(user % 4 == 0, "Europe/Berlin").when(user % 4 == 1, "UTC").when(user % 4 == 2, "Mars/Base")
    basis = F.when(i % 3 == 0, "utc").when(i % 3 == 1, "device_local")
    return b.table(spark, d, "events").select(i.alias("id"), raw.alias("raw"), form.alias("format"), zone.alias("zone"), basis.alias("basis"))


_RAW = f"""b_sec AS (SELECT event_id AS id, user_id, {BASE} + (event_id % 48) * 3600 + (event_id % 2) * 18144000 AS sec FROM events),
b_raw AS (SELECT id, sec, [('dhav'), ('unix_s'), ('unix_us'), ('other'), ('unix_s')][id % 5 + 1] AS format,
  CASE user_id % 4 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'UTC' WHEN 2 THEN 'Mars/Base' END AS zone, CASE id % 3 WHEN 0 THEN 'utc' WHEN 1 THEN 'device_local' END AS basis,
  CASE WHEN id % 5 = 4 THEN 2147483648 + id * 500000 WHEN id % 5 = 2 THEN sec * 1000000 ELSE sec END AS raw FROM b_sec),
b_stored AS (SELECT *, CASE WHEN format = 'dhav' AND id % 50 <> 0 THEN sec * 1000000 WHEN format = 'unix_s' AND raw <= 4294967295 THEN raw * 1000000 WHEN format = 'unix_us' THEN raw END AS us FROM b_raw),
b_kind AS (SELECT *, us IS NOT NULL AND format <> 'dhav' AND (coalesce(basis = 'utc', false) OR (basis IS NULL AND coalesce(zone = 'UTC', false))) AS instant,
  us IS NOT NULL AND (format = 'dhav' OR coalesce(basis = 'device_local', false)) AND coalesce(zone IN ('Europe/Berlin', 'UTC'), false) AS local FROM b_stored),
b_try AS (SELECT *, make_timestamp(us) AS w, CASE WHEN zone = 'Europe/Berlin' THEN [60, 120] ELSE [0] END AS ks FROM b_kind),
b_cands AS (SELECT id, min(c) AS c1, max(c) AS c2, count(DISTINCT c) AS n FROM (SELECT id, epoch_us(w - INTERVAL (k) MINUTE) AS c FROM (SELECT id, zone, w, unnest(ks) AS k FROM b_try WHERE local) t
  WHERE epoch_us(timezone(zone, timezone('UTC', w - INTERVAL (k) MINUTE))) = epoch_us(w)) u GROUP BY id),
b_decoded AS (SELECT t.*, CASE WHEN instant AND us IS NOT NULL THEN us WHEN local THEN c1 END AS lo, CASE WHEN instant THEN us WHEN local THEN c2 END + CASE WHEN format = 'unix_us' THEN 1 ELSE 1000000 END AS hi, coalesce(n, 0) AS n
  FROM b_try t LEFT JOIN b_cands c ON c.id = t.id)"""


@query("""SELECT id, lo, hi, array_to_string(list_filter([CASE WHEN format = 'other' THEN 'unsupported_format' END, CASE WHEN format = 'unix_s' AND raw >= 4294967295 THEN 'epoch32_u32_wrap' END,
CASE WHEN format = 'unix_s' AND raw > 2147483647 AND raw <= 4294967295 THEN 'epoch32_signed_overflow' END, CASE WHEN format <> 'other' AND us IS NULL THEN 'invalid_date' END,
CASE WHEN us IS NOT NULL AND year(make_timestamp(us)) NOT BETWEEN 1995 AND 2100 THEN 'implausible_date' END, CASE WHEN local AND n = 0 THEN 'dst_gap' END, CASE WHEN local AND n = 2 THEN 'dst_ambiguous' END,
CASE WHEN us IS NOT NULL AND NOT instant AND NOT local THEN 'tz_unknown' END], lambda x: x IS NOT NULL), ',') AS flags FROM b_decoded""", _RAW)
def decode_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return placement.decode(raw_timestamps(spark, d), ZONES).select("id", "lo", "hi", F.array_join("flags", ",").alias("flags"))


_WALLS = """SELECT id, CASE WHEN id % 4 = 0 THEN us WHEN id % 4 = 1 THEN us + 120000 END AS wall, CASE WHEN id % 4 = 3 THEN NULL ELSE us - CASE WHEN id % 4 = 1 THEN 7200000000 ELSE 0 END END AS instant,
CASE WHEN id % 4 <> 3 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || '.000000Z' END AS text FROM (SELECT event_id AS id, epoch_us(date_trunc('second', ts)) AS us FROM events) t"""


@query(_WALLS)
def parse_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Wall clocks with and without a fraction, no such date, no such form; instants with Z, an offset and none."""
    i, sec = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    plain = F.date_format(sec, "yyyy-MM-dd HH:mm:ss")
    wall = F.when(i % 4 == 0, plain).when(i % 4 == 1, F.concat(F.regexp_replace(plain, " ", "T"), F.lit(".12 "))).when(i % 4 == 2, F.concat(F.substring(plain, 1, 5), F.lit("02-30 10:00:00"))).otherwise(F.substring(plain, 3, 20))
    instant = F.concat(F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 4 == 1, "+02:00").when(i % 4 == 3, "").otherwise("Z"))
    rows = b.table(spark, d, "events").select(i.alias("id"), placement.parse_wall_clock(wall).alias("wall"), placement.parse_instant(instant).alias("instant"), F.when(i % 4 != 3, placement.iso(F.unix_micros(sec))).alias("text"))
    return rows


def placed_clips(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clips, their lines as timestamp records; evidences in Berlin, in UTC and without a zone."""
    line = b.table(spark, d, "lineitem")
    evidence = F.col("l_orderkey") % 3
    field = F.when(F.col("l_orderkey") % 2 == 0, F.when(F.col("l_linenumber") % 2 == 0, "lastSec").otherwise("firstSec")).otherwise("sec")
    raw = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 60
    records = line.where("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("clip_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos_"), raw.alias("raw"), field.alias("field"), F.lit("unix_s").alias("format"), F.when(evidence == 0, "Europe/Berlin").when(evidence == 1, "UTC").alias("zone"), F.when(evidence == 0, "device_local").alias("basis"))
    records = records.withColumn("pos", F.col("pos_.l_linenumber"))
    clips = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 7) * SECOND).alias("duration_us"))
    return placement.place(clips, placement.start_and_end(placement.decode(records, ZONES), ["clip_id"]), ["clip_id"])


_PLACED = """b_rec AS (SELECT l_orderkey AS clip, l_orderkey % 2 = 0 AS named, l_linenumber AS n, epoch_us(timezone('UTC', timezone(CASE WHEN l_orderkey % 3 = 0 THEN 'Europe/Berlin' ELSE 'UTC' END, make_timestamp(s * 1000000)))) AS z, s * 1000000 AS us
  FROM (SELECT *, epoch_us(l_shipdate) // 1000000 + l_linenumber * 60 AS s FROM lineitem WHERE l_orderkey % 11 <> 0) t),
b_ends AS (SELECT clip, CASE WHEN named THEN min(us) FILTER (n % 2 = 1) ELSE min(us) END AS s, CASE WHEN named THEN max(us) FILTER (n % 2 = 0) WHEN count(*) > 1 THEN max(us) END AS e FROM b_rec GROUP BY clip, named),
b_off AS (SELECT clip, s IS NOT NULL AND clip % 3 <> 2 AS ok, e IS NOT NULL AS has_end,
  CASE WHEN clip % 3 = 0 THEN epoch_us(timezone('Europe/Berlin', make_timestamp(s))) WHEN clip % 3 = 1 THEN s END AS lo, CASE WHEN clip % 3 = 0 THEN epoch_us(timezone('Europe/Berlin', make_timestamp(e))) WHEN clip % 3 = 1 THEN e END AS elo, s FROM b_ends),
b_clip AS (SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 7) * 1000000 ELSE 0 END AS dur, o.* FROM orders LEFT JOIN b_off o ON o.clip = o_orderkey),
b_placed AS (SELECT clip_id, CASE WHEN ok THEN lo END AS start_lo, CASE WHEN ok AND has_end THEN elo WHEN ok THEN lo + dur END AS end_lo, CASE WHEN ok AND has_end THEN 'record' WHEN ok AND dur > 0 THEN 'duration' WHEN ok THEN 'point' END AS end_from,
  CASE WHEN ok THEN NULL WHEN s IS NULL THEN 'no_timestamp' ELSE 'timezone_unknown' END AS reason FROM b_clip)"""


@query("SELECT clip_id, start_lo, end_lo, end_from, reason FROM b_placed", _PLACED)
def clip_placement(spark: SparkSession, d: str) -> DataFrame:
    return placed_clips(spark, d).select("clip_id", "start_lo", "end_lo", "end_from", "reason")


_INDEX = """b_last AS (SELECT clip_id, kind, max(run_id) AS run_id FROM (SELECT o_orderkey AS run_id, o_orderkey // 3 AS clip_id, o_orderpriority AS kind, o_orderstatus FROM orders) t WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b_both AS (SELECT l_orderkey AS run_id, 'part_' || (l_partkey % 5) AS class_name, 'object' AS source, l_linenumber * 7 AS frame FROM lineitem WHERE l_returnflag <> 'N'
  UNION ALL SELECT l_orderkey, 'motion', 'motion', l_linenumber * 10 FROM lineitem WHERE l_returnflag = 'N'),
b_index AS (SELECT clip_id, run_id, kind, class_name, frame, CAST(round(round(frame / 25.0, 6) * 1000000) AS BIGINT) AS nominal_us, source FROM b_last JOIN b_both USING (run_id))"""


@query("""SELECT i.clip_id, run_id, kind, class_name, frame, start_lo + nominal_us AS lo, start_lo + 1000000 + nominal_us AS hi, CASE WHEN start_lo IS NULL THEN 'unplaceable' ELSE 'placed' END AS placement,
lower(class_name || ' ' || replace(class_name, '_', ' ') || ' ' || source || ' clip ' || i.clip_id) AS text FROM b_index i LEFT JOIN b_placed p ON p.clip_id = i.clip_id""", _PLACED, _INDEX)
def event_index_build(spark: SparkSession, d: str) -> DataFrame:
    return indexed_events(spark, d).select("clip_id", "run_id", "kind", "class_name", "frame", "lo", "hi", "placement", "text")


def indexed_events(spark: SparkSession, d: str) -> DataFrame:
    line = b.table(spark, d, "lineitem")
    runs = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.expr("o_orderkey div 3").alias("clip_id"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    found = line.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("part_"), F.col("l_partkey") % 5).alias("class_name"), (F.col("l_linenumber") * 7).alias("frame"), F.col("l_discount").alias("confidence"))
    moved = line.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 10).alias("start_frame"))
    bars = placed_clips(spark, d).select("clip_id", "start_lo", "start_hi")
    return placement.index_events(runs, found, moved, bars, 25.0)


@query("SELECT kind, class_name = 'motion' AS motion, count(*) AS n, count(*) FILTER (start_lo IS NOT NULL) AS placed FROM b_index i LEFT JOIN b_placed p ON p.clip_id = i.clip_id GROUP BY 1, 2", _PLACED, _INDEX)
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind of run and source, with those that have a place."""
    rows = indexed_events(spark, d)
    return rows.groupBy("kind", (F.col("class_name") == "motion").alias("motion")).agg(F.count("*").alias("n"), F.count_if(F.col("placement") == "placed").alias("placed"))
