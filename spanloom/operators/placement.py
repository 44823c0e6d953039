"""Raw recorder timestamps to uncertain instants, and clips to a timeline. A zone is never assumed: without one, no instant."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import total_order
from .timeline import SECOND, candidates, unpack_datetime

U32, I32 = (1 << 32) - 1, (1 << 31) - 1
#: First and last microsecond of the years 1 to 9999.
FIRST_US, LAST_US = -62_135_596_800_000_000, 253_402_300_799_999_999
#: Years outside these are flagged, not refused.
PLAUSIBLE = (1995, 2100)
KINDS = ("dhav", "unix_s", "unix_us")
_WALL = r"^\s*(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?\s*$"


def parse_wall_clock(text: Column) -> Column:
    """Microseconds of 'YYYY-MM-DD HH:MM:SS[.ffffff]' read as if UTC; null for another form or no real date."""
    part = lambda k: F.regexp_extract(text, _WALL, k)
    whole = lambda k: F.when(part(k) != "", part(k).cast("int"))
    fraction = F.rpad(part(7), 6, "0").cast("long")
    sane = (whole(4) <= 23) & (whole(5) <= 59) & (whole(6) <= 59)
    ts = F.try_make_timestamp_ntz(whole(1), whole(2), whole(3), whole(4), whole(5), whole(6).cast("decimal(8,6)"))
    return F.when(sane, F.unix_micros(ts.cast("timestamp")) + F.coalesce(F.when(part(7) != "", fraction), F.lit(0)))


def parse_instant(text: Column) -> Column:
    """Microseconds of an ISO 8601 instant; null unless it states its offset."""
    stated = F.trim(text).rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    return F.when(stated, F.unix_micros(F.try_to_timestamp(F.trim(text))))


def iso(us: Column) -> Column:
    """UTC text with microseconds."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def checked_zones(zones: Sequence[str]) -> list[str]:
    """Those of zones that are known; Spark fails on any other while it runs."""
    return sorted(set(zones) & available_timezones())


def decode(df: DataFrame, zones: Sequence[str]) -> DataFrame:
    """df (raw, format, zone, basis) with stored_us, lo, hi, candidates and flags.

    Packed dates are wall clocks; epochs are instants on basis 'utc' (or without a basis in zone 'UTC') and wall clocks
    on basis 'device_local'. A wall clock is placed only in one of `zones`.
    """
    raw, kind = F.col("raw"), F.col("format")
    second, micro = kind == "unix_s", kind == "unix_us"
    wrapped = second & ((raw > U32) | (raw < 0))
    packed = (unpack_datetime(raw) * SECOND).cast("long")
    stored = F.when(kind == "dhav", packed).when(second & ~wrapped, raw * SECOND).when(micro & raw.between(FIRST_US, LAST_US), raw)
    supported = F.coalesce(kind.isin(*KINDS), F.lit(False))
    known = F.coalesce(F.col("zone").isin(*checked_zones(zones)), F.lit(False))
    bad = stored.isNull()
    instant = ~bad & (kind != "dhav") & ((F.col("basis") == "utc") | (F.col("basis").isNull() & F.col("zone").eqNullSafe("UTC")))
    naive = ~bad & ((kind == "dhav") | ((F.col("basis") == "device_local") & F.col("zone").isNotNull()))
    rows = df.withColumns({"stored_us": stored, "_instant": F.coalesce(instant, F.lit(False)), "_local": F.coalesce(naive, F.lit(False)) & known})
    zone = F.coalesce(F.when(known, F.col("zone")), F.lit("UTC"))
    local = F.transform(candidates(F.timestamp_micros(F.coalesce("stored_us", F.lit(0))), zone), lambda c: F.unix_micros(c))
    rows = rows.withColumn("candidates", F.when(F.col("_local"), local))
    size, width = F.size("candidates"), F.when(micro, 1).otherwise(SECOND)
    found = F.col("_local") & (size > 0)
    flag = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    ok = F.col("stored_us").isNotNull()
    flags = F.array_compact(
        F.array(
            flag("unsupported_format", ~supported),
            flag("epoch32_u32_wrap", second & ((raw > U32) | (raw < 0) | (raw == U32))),
            flag("epoch32_signed_overflow", second & (raw > I32) & (raw <= U32)),
            flag("invalid_date", supported & ~ok),
            flag("implausible_date", ok & ~F.year(F.timestamp_micros("stored_us")).between(*PLAUSIBLE)),
            flag("dst_gap", F.col("_local") & (size == 0)),
            flag("dst_ambiguous", F.col("_local") & (size == 2)),
            flag("tz_unknown", ok & ~F.col("_instant") & ~F.col("_local")),
        )
    )
    lo = F.when(F.col("_instant"), F.col("stored_us")).when(found, F.element_at("candidates", 1))
    hi = F.when(F.col("_instant"), F.col("stored_us")).when(found, F.element_at("candidates", -1)) + width
    return rows.withColumns({"lo": lo, "hi": hi, "flags": flags}).drop("_instant", "_local")


def start_and_end(records: DataFrame, key: list[str]) -> DataFrame:
    """(key, first, last) of decoded records (pos, raw, field, format, lo, hi, flags).

    By the field's name where one tells start or end, else the least and the greatest raw value of the first record's
    format; of equals the first one, for a nameless end the last.
    """
    name = F.lower("field")
    role = F.when(name.contains("first") | name.contains("start"), "start").when(name.contains("last") | name.contains("end"), "end").otherwise("")
    own = W.partitionBy(*key)  # a clip's few records
    rows = records.withColumn("role", role).withColumn("named", F.max(F.when(F.col("role") != "", 1).otherwise(0)).over(own)).withColumn("main", F.min_by("format", "pos").over(own))
    same = (F.col("named") == 0) & (F.col("format") == F.col("main"))
    row = F.struct("raw", "lo", "hi", "flags")
    least, most = F.struct("raw", "pos"), F.struct("raw", (-F.col("pos")).alias("before"))
    grouped = rows.groupBy(*key).agg(
        F.min_by(F.when(F.col("role") == "start", row), F.when(F.col("role") == "start", least)).alias("s1"),
        F.max_by(F.when(F.col("role") == "end", row), F.when(F.col("role") == "end", most)).alias("e1"),
        F.min_by(F.when(same, row), F.when(same, least)).alias("s2"),
        F.max_by(F.when(same, row), F.when(same, least)).alias("e2"),
        F.count_if(same).alias("n"),
    )
    return grouped.select(*key, F.coalesce("s1", "s2").alias("first"), F.coalesce("e1", F.when(F.col("n") > 1, F.col("e2"))).alias("last"))


def place(clips: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """clips (key, duration_us) with start_lo, start_hi, end_lo, end_hi, end_from and, of unplaceable ones, the reason."""
    rows = clips.join(ends, key, "left")
    has = lambda f: F.coalesce(F.array_contains("first.flags", f), F.lit(False))
    placed, end = F.col("first.lo").isNotNull(), F.col("last.lo").isNotNull()
    lasting = F.coalesce(F.col("duration_us"), F.lit(0)) > 0
    ending = lambda c: F.when(placed & end, F.col(f"last.{c}")).when(placed & lasting, F.col(f"first.{c}") + F.col("duration_us")).otherwise(F.col(f"first.{c}"))
    reason = F.when(placed, None).when(F.col("first").isNull(), "no_timestamp").when(has("tz_unknown"), "timezone_unknown").when(has("dst_gap"), "dst_gap").when(has("invalid_date"), "invalid_date").otherwise("other")
    start = {"start_lo": F.col("first.lo"), "start_hi": F.col("first.hi"), "end_lo": ending("lo"), "end_hi": ending("hi")}
    flags = F.array_sort(F.array_union(F.coalesce("first.flags", F.array()), F.coalesce("last.flags", F.array())))
    from_ = F.when(placed & end, "record").when(placed & lasting, "duration").when(placed, "point")
    return rows.withColumns(start | {"end_from": from_, "reason": reason, "all_flags": flags}).drop("first", "last")


def index_events(runs: DataFrame, detections: DataFrame, motions: DataFrame, bars: DataFrame, fps: float) -> DataFrame:
    """Events of the latest completed run of each (clip, kind), placed by their clip's bar.

    (clip_id, run_id, kind, class_name, frame, nominal_us, lo, hi, placement, text); detections give a frame each, motion
    intervals their first one. bars: (clip_id, start_lo, start_hi), null where a clip has no place.
    """
    latest = runs.where("status = 'completed'").groupBy("clip_id", "kind").agg(F.max("run_id").alias("run_id"))
    both = detections.select("run_id", "class_name", "frame", "confidence").withColumn("source", F.lit("object")).unionByName(
        motions.select("run_id", F.lit("motion").alias("class_name"), F.col("start_frame").alias("frame"), F.lit(None).cast("double").alias("confidence")).withColumn("source", F.lit("motion"))
    )
    nominal = F.round(F.col("frame") / F.lit(fps), 6)
    rows = latest.join(both, "run_id").withColumn("nominal_us", F.round(nominal * SECOND).cast("long")).join(bars, "clip_id", "left")
    words = F.lower(F.concat_ws(" ", "class_name", F.regexp_replace("class_name", "_", " "), "source", F.concat(F.lit("clip "), F.col("clip_id").cast("string"))))
    at = {c: F.col(f"start_{c}") + F.col("nominal_us") for c in ("lo", "hi")}
    return rows.withColumns(at | {"placement": F.when(F.col("start_lo").isNull(), "unplaceable").otherwise("placed"), "text": words}).drop("start_lo", "start_hi")


def upserted(stored: DataFrame, fresh: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The index after fresh rows replace stored ones, by natural key, and (action, n): how many were inserted, updated and removed.

    stored has `id` and the columns of fresh. A key that stays keeps its id; new keys get the ids after the greatest one, in
    the order of their key; keys that fresh lacks are gone, and their ids are not given again while greater ones are
    stored. Keys differ in each table; a null in a key is a value.
    """
    top = stored.agg(F.max("id")).first()[0] or 0
    known = stored.select("id", *(F.col(k).alias(f"_{k}") for k in key))
    due = fresh.select(*(F.col(k).alias(f"_{k}") for k in key))
    both = lambda a: reduce(and_, (a[k].eqNullSafe(F.col(f"_{k}")) for k in key))
    kept = fresh.join(known, both(fresh)).select("id", *fresh.columns)
    new = fresh.join(known.drop("id"), both(fresh), "left_anti")
    numbered = total_order(new, [F.asc_nulls_first(k) for k in key], "_n").withColumn("id", F.col("_n") + top).select("id", *fresh.columns)
    gone = stored.join(due, both(stored), "left_anti")
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("action"), "n")
    return kept.unionByName(numbered), count(new, "insert").unionByName(count(kept, "update")).unionByName(count(gone, "remove"))
