"""Events on a time axis: instants are microseconds since 1970 (BIGINT) with uncertain bounds lo <= hi; null is unplaceable."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND, DAY = 1_000_000, 86_400_000_000


@dataclass(frozen=True)
class EventFilter:
    """What a search asks for. Lists are any-of and empty for all; the kinds of test are all-of; a null confidence matches none."""

    classes: tuple[str, ...] = ()
    channels: tuple[int, ...] = ()
    clips: tuple[int, ...] = ()
    confidence: tuple[str, float] | None = None
    placement: str | None = None
    terms: tuple[str, ...] = field(default=())

    def predicate(self) -> Column:
        tests = [F.col(c).isin(*v) for c, v in (("class_name", self.classes), ("channel", self.channels), ("clip_id", self.clips)) if v]
        if self.confidence:
            op, x = self.confidence
            if op not in (">", ">=", "<", "<=", "=", "!="):
                raise ValueError(f"no comparison: {op}")
            tests.append(F.expr(f"confidence is not null and confidence {op} {float(x)!r}"))
        if self.placement:
            tests.append(F.col("placement") == self.placement)
        if self.terms:  # one pass over the text for all terms
            wanted = F.array(*(F.lit(t.lower()) for t in dict.fromkeys(self.terms)))
            tests.append(F.size(F.array_except(wanted, tokens(F.col("text")))) == 0)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


def event_order() -> list[Column]:
    return [F.col("lo").asc_nulls_last(), F.col("clip_id"), F.col("id")]


def search(events: DataFrame, what: EventFilter, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Matching events in event order; with a limit, a page of them."""
    found = events.where(what.predicate())
    return found if limit is None else found.orderBy(*event_order()).offset(offset).limit(limit)


def in_daily_window(lo: Column, hi: Column, begin_us: int, end_us: int) -> Column:
    """'within', 'overlaps_boundary' or null: how [lo, hi] lies to a daily closed window, which may pass midnight."""
    length = (end_us - begin_us) % DAY
    days = F.sequence(F.floor(lo / DAY) - 1, F.floor(hi / DAY))
    start = lambda d: d * DAY + begin_us
    within = F.exists(days, lambda d: (start(d) <= lo) & (hi <= start(d) + length))
    touches = F.exists(days, lambda d: (lo <= start(d) + length) & (hi >= start(d)))
    return F.when(within, "within").when(touches, "overlaps_boundary")


def sessions(events: DataFrame, key: list[str], gap_us: int) -> DataFrame:
    """(key, start, end, n): runs of events of which each begins no more than gap_us after the latest end before it."""
    from .intervals import islands

    before = W.partitionBy(*key).orderBy("lo", "id").rowsBetween(W.unboundedPreceding, -1)
    rows = events.where("lo is not null").withColumn("reach", F.max("end").over(before))
    marked = islands(rows, key, ["lo", "id"], F.col("reach").isNull() | (F.col("lo") - F.col("reach") > gap_us))
    return marked.groupBy(*key, "island").agg(F.min("lo").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def presentation_order(events: DataFrame, key: list[str]) -> DataFrame:
    """events with `place`, 1 up within the key; a null channel comes last.

    Places come from one order over all keys (ordering.total_order), so a key of any size is in no single window.
    """
    from .ordering import total_order

    order = [*(F.asc_nulls_first(k) for k in key), F.col("lo"), F.col("end"), F.col("channel").isNull(), F.col("channel"), F.col("clip_id"), F.col("id")]
    placed = total_order(events.where("lo is not null"), order, "_at")
    first = placed.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min("_at").alias("_first"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    return placed.join(first, same).withColumn("place", F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *(f"_{k}" for k in key))


def gaps(events: DataFrame, key: list[str], min_gap_us: int = SECOND) -> DataFrame:
    """(key, a, b, gap, least, most, certain): stretches between neighbours of a key longer than min_gap_us. A null in the key is a key."""
    w = W.partitionBy(*key).orderBy("lo", "end", "id")
    nxt = lambda c: F.lead(c).over(w)
    rows = events.where("lo is not null").select(*key, F.col("id").alias("a"), nxt("id").alias("b"), (nxt("lo") - F.col("end")).alias("gap"), (nxt("lo") - F.col("end") - (F.col("hi") - F.col("lo"))).alias("least"), (nxt("hi") - F.col("end")).alias("most"))
    return rows.where(F.col("gap") > min_gap_us).withColumn("certain", F.col("least") > 0)


def unpack_datetime(raw: Column) -> Column:
    """Seconds since 1970 of a 32-bit packed wall clock (s 0-5, min 6-11, h 12-16, day 17-21, month 22-25, year - 2000 from 26); null if there is no such date."""
    bits = lambda n, width: F.shiftright(raw, n).bitwiseAND((1 << width) - 1).cast("int")
    when = F.try_make_timestamp_ntz(bits(26, 6) + 2000, bits(22, 4), bits(17, 5), bits(12, 5), bits(6, 6), bits(0, 6).cast("decimal(8,6)"))
    return F.unix_micros(when.cast("timestamp")) / SECOND


def pack_datetime(ts: Column) -> Column:
    part = lambda c, n: F.shiftleft(c.cast("long"), n)
    return F.second(ts).cast("long") + part(F.minute(ts), 6) + part(F.hour(ts), 12) + part(F.dayofmonth(ts), 17) + part(F.month(ts), 22) + part(F.year(ts) - 2000, 26)


def candidates(wall: Column, zone: str | Column) -> Column:
    """The instants (none, one or two, in order) at which clocks of the zone show the wall time; wall: as if UTC."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    shifted = lambda k: wall + F.expr(f"interval {k} days")
    offset = lambda k: F.unix_micros(F.from_utc_timestamp(shifted(k), zone)) - F.unix_micros(shifted(k))
    either = F.array(*(F.timestamp_micros(F.unix_micros(wall) - offset(k)) for k in (-1, 1)))
    return F.array_sort(F.array_distinct(F.filter(either, lambda c: F.from_utc_timestamp(c, zone) == wall)))


def drift_fit(observations: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, slope, intercept): least squares of y on x; a slope of 0 where x doesn't vary."""
    fit = observations.groupBy(*key).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("y").alias("mean"))
    return fit.select(*key, "n", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "mean").alias("intercept"))


def link_sides(segments: DataFrame, edges: DataFrame, window_us: int, bucket_us: int) -> tuple[DataFrame, DataFrame]:
    """Segments of the smaller (_l) and of the greater (_r) camera of each edge (x, y), in each bucket from their start up to a window behind their end."""
    own = F.coalesce("transit", F.lit(window_us)) if "max_transit_us" in edges.columns else F.lit(window_us)
    transit = F.col("max_transit_us") if "max_transit_us" in edges.columns else F.lit(None).cast("long")
    both = edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), transit.alias("transit"))
    each = both.groupBy("x", "y").agg(F.max("transit").alias("transit")).select("x", "y", own.alias("window"))
    last = F.greatest(F.col("start"), F.col("end") + F.col("window"))
    span = F.sequence(F.floor(F.col("start") / bucket_us), F.floor(last / bucket_us))

    def side(camera: str, k: str) -> DataFrame:
        dealt = segments.join(each, F.col("camera") == F.col(camera))
        return dealt.select("x", "y", "class_name", F.explode(span).alias("bucket"), *(F.col(c).alias(f"{c}_{k}") for c in ("id", "start", "end", "window")))

    return side("x", "l"), side("y", "r")


def link_candidates(segments: DataFrame, edges: DataFrame, window_us: int, bucket_us: int = DAY) -> DataFrame:
    """(a, b, class_name, least, most): segments of one class on two adjacent cameras whose least separation is within the window.

    An edge's own max_transit_us, where edges have one that isn't null, takes the window's place. Segments are dealt once
    for each edge of their camera, by time, each up to a window behind its end; a pair is met once, in the bucket where
    the later of the two begins.
    """
    left, right = link_sides(segments, edges, window_us, bucket_us)
    met = left.join(right.drop("window_r"), ["x", "y", "class_name", "bucket"])
    once = F.floor(F.greatest("start_l", "start_r") / bucket_us) == F.col("bucket")
    near = (F.col("start_r") <= F.col("end_l") + F.col("window_l")) & (F.col("start_l") <= F.col("end_r") + F.col("window_l"))
    pairs = met.where(near & once & (F.col("id_l") != F.col("id_r")))
    least = F.greatest(F.lit(0), F.col("start_r") - F.col("end_l"), F.col("start_l") - F.col("end_r"))
    most = F.greatest(F.col("end_r") - F.col("start_l"), F.col("end_l") - F.col("start_r"))
    return pairs.select(F.least("id_l", "id_r").alias("a"), F.greatest("id_l", "id_r").alias("b"), "class_name", least.alias("least"), most.alias("most"))


def reconcile(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, action): new rows are inserted; suggested ones updated or, where no longer found, deleted; decided ones kept."""
    both = old.select(*key, F.col("status").alias("status"), F.lit(True).alias("is_old")).join(new.select(*key, F.lit(True).alias("is_new")), key, "full_outer")
    action = F.when(F.col("is_old").isNull(), "insert").when(F.col("status") != "suggested", "keep").when(F.col("is_new").isNull(), "delete").otherwise("update")
    return both.select(*key, action.alias("action"))
