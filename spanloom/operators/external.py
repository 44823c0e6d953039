"""Times of other sources: logs with a stated format and zone, overlay texts whose day and month may be ambiguous, zoned windows."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import DAY, SECOND, candidates

#: Directives of a stated format: the pattern where fields adjoin, the one where they are parted, the resolution in microseconds.
DIRECTIVES = {
    "Y": ("yyyy", "yyyy", DAY), "y": ("yy", "yy", DAY), "m": ("MM", "M", DAY), "d": ("dd", "d", DAY), "b": ("MMM", "MMM", DAY), "B": ("MMMM", "MMMM", DAY), "H": ("HH", "H", 3600 * SECOND), "I": ("hh", "h", 3600 * SECOND),
    "p": ("a", "a", DAY), "M": ("mm", "m", 60 * SECOND), "S": ("ss", "s", SECOND), "f": ("SSSSSS", "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", 1),
}
SHORT = {"T": "%H:%M:%S", "R": "%H:%M", "F": "%Y-%m-%d", "D": "%m/%d/%y"}


def java_pattern(stated: str) -> tuple[str, int]:
    """A stated format (%Y-%m-%d %H:%M:%S) as a date-time pattern, and its resolution: that of its finest field."""
    for name, long in SHORT.items():
        stated = stated.replace(f"%{name}", long)
    out, finest = [], DAY
    parts = re.findall(r"%(.)|([^%]+)", stated)
    for k, (name, text) in enumerate(parts):
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        elif name == "%":
            out.append("'%'")
        else:
            if name not in DIRECTIVES:
                raise ValueError(f"%{name} isn't supported")
            tight, loose, size = DIRECTIVES[name]
            adjoins = k + 1 < len(parts) and parts[k + 1][0] not in ("", "%") or k > 0 and parts[k - 1][0] not in ("", "%")
            out.append(tight if adjoins else loose)
            finest = min(finest, size)
    return "".join(out), finest


def log_entries(rows: DataFrame, nodes: DataFrame, stated: str, zone: str) -> DataFrame:
    """rows (log_id, row_number, time, event, location) placed: node, lo, hi, flag and the reason of unplaced ones.

    Times are wall clocks of the zone in the stated format. One that the zone never shows is unplaced, one that it shows
    twice spans both instants; an instant is uncertain by the format's resolution. nodes: (location, node).
    """
    pattern, finest = java_pattern(stated)
    time, place = F.trim(F.coalesce("time", F.lit(""))), F.trim(F.coalesce("location", F.lit("")))
    wall = F.when(time != "", F.try_to_timestamp(time, F.lit(pattern)))
    local = F.when(F.col("_wall").isNotNull(), F.transform(candidates(F.coalesce("_wall", F.timestamp_micros(F.lit(0))), zone), lambda c: F.unix_micros(c)))
    known = nodes.groupBy("location").agg(F.min("node").alias("node"))
    own = rows.select("log_id", "row_number", time.alias("time"), F.coalesce("event", F.lit("")).alias("event"), place.alias("location")).withColumn("_wall", wall).withColumn("_at", local)
    n = F.coalesce(F.size("_at"), F.lit(0))
    flag = F.when(F.col("_wall").isNotNull() & (n == 0), "dst_gap").when(n == 2, "dst_ambiguous").otherwise("")
    reason = F.when(F.col("_wall").isNull(), "format").when(n == 0, "dst_gap")
    placed = own.select("log_id", "row_number", "time", "event", "location", F.when(n > 0, F.get("_at", F.lit(0))).alias("lo"), F.when(n > 0, F.element_at(F.col("_at"), F.greatest(n, F.lit(1)))).alias("hi_"), flag.alias("flag"), reason.alias("reason"))
    return placed.join(known, "location", "left").select("log_id", "row_number", "time", "event", "location", "node", "lo", (F.col("hi_") + finest).alias("hi"), "flag", "reason")


def in_zone_window(lo: Column, hi: Column, zone: str, begin_us: int = 0, end_us: int = DAY - 1, on: datetime.date | None = None) -> Column:
    """'within', 'overlaps_boundary' or null: an uncertain instant against a window of the zone's wall clock, on one day or each.

    A window whose end lies before its begin ends on the next day. Both bounds belong to it.
    """
    wall = lambda c: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c), zone))
    a, b = wall(lo), wall(hi)
    days = F.sequence(F.floor(a / DAY) - 1, F.floor(b / DAY))
    if on is not None:
        day = (on - datetime.date(1970, 1, 1)).days
        days = F.filter(days, lambda d: d == day)
    start, stop = (lambda d: d * DAY + begin_us), (lambda d: d * DAY + end_us + (0 if end_us >= begin_us else DAY))
    touches = lambda d: (start(d) <= b) & (a <= stop(d))
    within = F.exists(days, lambda d: (start(d) <= a) & (b <= stop(d)))
    return F.when(within, "within").when(F.exists(days, touches), "overlaps_boundary")


def holds_words(text: Column | str, words: list[str]) -> Column:
    """Every word occurs somewhere in the text, within other words too; case doesn't matter."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(True)
    for w in words:
        out = out & F.contains(low, F.lit(w.lower()))
    return out


#: What overlays show (fixed): year first, or two numbers before the year; the blank before the time may be missing.
YEAR_FIRST = r"(\d{4})([-/.])(\d{2})\2(\d{2})\s*(\d{1,2}):(\d{2}):(\d{2})\s*(AM|PM)?"
YEAR_LAST = r"(\d{2})([-/.])(\d{2})\2(\d{4})\s*(\d{1,2}):(\d{2}):(\d{2})\s*(AM|PM)?"


def overlay_times(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with `overlay`, struct(status, candidates, format): clocks read off pictures.

    status is ok, ambiguous (day and month can be either way; both instants are candidates) or unparsed. Candidates are
    microseconds of the wall clock as if it were UTC. A column `overlay` of rows is replaced.
    """
    t = F.upper(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    first = rows.drop("overlay").withColumn("_text", t).withColumn("_first", F.col("_text").rlike(YEAR_FIRST))
    groups = lambda p: F.array(*(F.regexp_extract("_text", p, k) for k in (1, 3, 4, 5, 6, 7, 8)))
    parts = first.withColumn("_p", F.when(F.col("_first"), groups(YEAR_FIRST)).otherwise(groups(YEAR_LAST)))
    number = F.transform(F.slice("_p", 1, 6), lambda x: F.when(x != "", x).cast("int"))
    parts = parts.withColumns({"_n": number, "_half": F.col("_p")[6]})
    n = lambda k: F.col("_n")[k]
    hour = F.when(F.col("_half") == "", n(3)).when(n(3).between(1, 12), n(3) % 12 + F.when(F.col("_half") == "PM", 12).otherwise(0))
    second = F.when(n(5) < 60, n(5)).cast("decimal(8,6)")
    parts = parts.withColumns({"_h": hour, "_s": second})
    wall = lambda y, m, d: F.unix_micros(F.try_make_timestamp_ntz(n(y), n(m), n(d), F.col("_h"), n(4), F.col("_s")).cast("timestamp"))
    made = parts.withColumns({"_a": F.when(F.col("_first"), wall(0, 1, 2)).otherwise(wall(2, 1, 0)), "_b": F.when(~F.col("_first"), wall(2, 0, 1))})
    both = F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))
    found = F.array_distinct(F.array_compact(F.array("_a", "_b")))
    name = F.when(F.col("_first"), "YYYY-MM-DD HH:MM:SS").when(both, "DD-MM-YYYY or MM/DD/YYYY").when(F.col("_a").isNotNull(), "DD-MM-YYYY HH:MM:SS").otherwise("MM/DD/YYYY HH:MM:SS")
    status = F.when(both, "ambiguous").when(F.coalesce("_a", "_b").isNotNull(), "ok").otherwise("unparsed")
    half = F.when(F.col("_half") != "", " AM/PM").otherwise("")
    overlay = F.struct(status.alias("status"), found.alias("candidates"), F.when(status == "unparsed", "").otherwise(F.concat(name, half)).alias("format"))
    return made.withColumn("overlay", overlay).drop("_text", "_first", "_p", "_n", "_half", "_h", "_s", "_a", "_b")
