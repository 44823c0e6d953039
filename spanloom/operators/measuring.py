"""Statistics over measurements: motion runs, clock drift, overlay checks, validation counters, estimates and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import average_ranks, band

# Two-sided 95 % points of Student's t by degrees of freedom.
T975 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110,
    18: 2.101, 19: 2.093, 20: 2.086, 21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980,
}
Z975 = 1.960
#: Parts per million from which a drift is warned of, and from which its fit is not used; seconds under which a baseline is short.
HUGE_PPM, UNUSABLE_PPM, SHORT_S = 500.0, 10_000.0, 3600.0
# Factors of the recoverability rule.
DECODE = {"ok": 1.0, "decode_errors": 0.5, "export_failed": 0.0}
REASSEMBLED, UNCHECKED = 0.9, 0.9


def rounded(x: Column, places: int) -> Column:
    """x to a number of decimal places as in binary: x * 10^places to the nearest whole, halves away from zero, and back.

    F.round takes the shortest decimal text of x, so that 0.285 becomes 0.29, though the double lies below it.
    """
    scale = float(10**places)
    return F.round(x * scale) / scale


def t_critical(df: Column) -> Column:
    """Two-sided 95 % point; between the table's rows by 1 / df, towards Z975 beyond the last; null under 1."""
    known = sorted(T975)
    out = F.when(df < 1, None)
    for lo, hi in zip(known, [*known[1:], None]):
        out = out.when(df == lo, T975[lo])
        if hi is None or hi > lo + 1:
            end, value = (0.0, Z975) if hi is None else (1.0 / hi, T975[hi])
            share = (1.0 / df - 1.0 / lo) / (end - 1.0 / lo)
            between = T975[lo] + share * (value - T975[lo])
            out = out.when(df > lo, between) if hi is None else out.when((df > lo) & (df < hi), between)
    return out


def motion_runs(samples: DataFrame, key: list[str], merge_gap: int, least: int, fps: float) -> DataFrame:
    """(key, start_frame, end_frame, start_s, end_s, n_samples, peak, mean) of runs of moving samples (at, frame, score, moving).

    At most merge_gap still samples lie between two moving ones of a run; runs of fewer than `least` moving ones are dropped.
    """
    w = W.partitionBy(*key).orderBy("at")
    numbered = samples.withColumn("n", F.row_number().over(w)).where("moving")
    new = F.coalesce(F.col("n") - F.lag("n").over(W.partitionBy(*key).orderBy("n")) > merge_gap + 1, F.lit(True))
    runs = numbered.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*key, "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_samples"), F.round(F.max("score"), 6).alias("peak"), F.round(F.avg("score"), 6).alias("mean"))
    at = lambda c: F.round(F.col(c) / F.lit(fps), 6)
    return out.where(F.col("n_samples") >= least).withColumns({"start_s": at("start_frame"), "end_s": at("end_frame")}).drop("run")


def drift_model(observations: DataFrame, key: list[str], reading_s: float, assumed_ppm: float = 50.0) -> DataFrame:
    """A clock model of each key from (device_us, true_us) readings, each uncertain by reading_s.

    (method, n, offset_s, half_s, drift_ppm, drift_half_ppm, sigma_s, df, t, xbar, sxx, x0_us, usable, warnings): x is
    seconds since the first reading, y the true time less the device's. One reading, or readings at one device time,
    give an offset only. A clock whose true time runs back, or of UNUSABLE_PPM or more, is not usable.
    """
    own = W.partitionBy(*key)
    ordered = own.orderBy("device_us", "true_us")
    before = lambda c: F.lag(c).over(ordered)
    rows = observations.withColumns({
        "x0": F.min("device_us").over(own),
        "back": (F.col("device_us") > before("device_us")) & (F.col("true_us") <= before("true_us")),
        "twice": (F.col("device_us") == before("device_us")) & (F.col("true_us") != before("true_us")),
    })
    x, y = (F.col("device_us") - F.col("x0")) / 1e6, (F.col("true_us") - F.col("device_us")) / 1e6
    rows = rows.select(*key, "x0", x.alias("x"), y.alias("y"), "back", "twice")
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("x0").alias("x0_us"), F.avg("x").alias("xbar"), F.avg("y").alias("ybar"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"), F.max("x").alias("last"), F.coalesce(F.max("back"), F.lit(False)).alias("back"), F.coalesce(F.max("twice"), F.lit(False)).alias("twice"))
    n, sxx, xbar = F.col("n"), F.col("sxx"), F.col("xbar")
    flat = (n == 1) | (sxx == 0)
    slope = F.when(flat, 0.0).otherwise(F.col("sxy") / sxx)
    g = g.withColumn("slope", slope).withColumn("df", F.when(flat, n - 1).otherwise(n - 2))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.when(flat, 0.0).otherwise(F.col("slope") * F.col("sxy")))
    read_sd = reading_s / 3**0.5
    sigma = F.when(F.col("df") >= 1, F.greatest(F.sqrt(rest / F.col("df")), F.lit(read_sd))).otherwise(read_sd)
    t = F.when(F.col("df") >= 1, t_critical(F.col("df"))).otherwise(Z975)
    g = g.withColumns({"sigma_s": sigma, "t": t})
    se = F.sqrt(1.0 / n + xbar * xbar / sxx)
    half = F.when(n == 1, reading_s).when(flat, F.col("t") * F.col("sigma_s") / F.sqrt(n)).otherwise(F.col("t") * F.col("sigma_s") * se)
    ppm = F.col("slope") * 1e6
    huge, short = F.abs(ppm) >= UNUSABLE_PPM, F.col("last") < SHORT_S
    warn = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    warnings = F.array_compact(F.array(warn("non_monotonic", F.col("back")), warn("same_device_time", F.col("twice")), warn("single", n == 1), warn("one_device_time", (n > 1) & flat), warn("implausible_drift", huge), warn("large_drift", ~huge & (F.abs(ppm) > HUGE_PPM)), warn("short_baseline", ~flat & short)))
    return g.select(
        *key, F.when(flat, "offset_only").otherwise("linear").alias("method"), "n", (F.col("ybar") - F.col("slope") * xbar).alias("offset_s"), half.alias("half_s"), ppm.alias("drift_ppm"),
        F.when(~flat, F.col("t") * F.col("sigma_s") / F.sqrt(sxx) * 1e6).alias("drift_half_ppm"), "sigma_s", "df", "t", "xbar", "sxx", "x0_us", (~F.col("back") & ~huge).alias("usable"), warnings.alias("warnings"), F.lit(assumed_ppm).alias("assumed_ppm"),
    )


def corrected(events: DataFrame, models: DataFrame, key: list[str]) -> DataFrame:
    """events (lo, hi) with corrected_lo and corrected_hi by a usable model: the correction and its 95 % half-width at each bound."""
    rows = events.join(models.where("usable").drop("warnings"), key, "left")

    def at(c: str, sign: int) -> Column:
        x = (F.col(c) - F.col("x0_us")) / 1e6
        centre = F.col("offset_s") + F.col("drift_ppm") * 1e-6 * x
        far = x - F.col("xbar")
        half = F.when(F.col("method") == "offset_only", F.col("half_s") + F.col("assumed_ppm") * 1e-6 * F.abs(far)).otherwise(F.col("t") * F.col("sigma_s") * F.sqrt(1.0 / F.col("n") + far * far / F.col("sxx")))
        return F.col(c) + F.round((centre + sign * half) * 1e6).cast("long")

    return rows.select(*events.columns, at("lo", -1).alias("corrected_lo"), at("hi", 1).alias("corrected_hi"))


def overlay_verdict(readings: DataFrame, key: list[str], tolerance_s: float, least: int) -> DataFrame:
    """(key, n, middle, status) of overlay readings (delta, null if unreadable): pass, fail, inconclusive or unreadable."""
    g = readings.groupBy(*key).agg(F.count("delta").alias("n"), F.median("delta").alias("middle"), F.bool_and(F.abs("delta") <= tolerance_s).alias("all"))
    status = F.when((F.col("n") < least) | (F.col("n") == 0), "unreadable").when(F.col("all"), "pass").when(F.abs("middle") > tolerance_s, "fail").otherwise("inconclusive")
    return g.select(*key, "n", "middle", status.alias("status"))


def recoverability(clips: DataFrame) -> DataFrame:
    """clips (kind, decode_status, irap_count, reassembled, engine, validated) with available, estimate and its band.

    The product of four factors; an orphan is 0, and without a stored decode test there is no estimate.
    """
    status = F.col("decode_status")
    decoded = F.when(status == "ok", DECODE["ok"]).when(status == "decode_errors", DECODE["decode_errors"]).when(status == "export_failed", DECODE["export_failed"])
    checked = ((F.col("engine") == "generic") & F.col("validated")) | (status == "ok")
    product = decoded * F.when(F.col("irap_count") > 0, 1.0).otherwise(0.0) * F.when(F.col("reassembled"), REASSEMBLED).otherwise(1.0) * F.when(checked, 1.0).otherwise(UNCHECKED)
    estimate = F.when(F.col("kind") == "orphan", 0.0).otherwise(F.round(product, 4))
    return clips.withColumn("estimate", estimate).withColumns({"available": F.col("estimate").isNotNull(), "band": F.when(F.col("estimate").isNotNull(), band(F.col("estimate")))})


def agreement(df: DataFrame, key: list[str], estimate: str, actual: str) -> DataFrame:
    """(key, n, pearson, spearman, mae, signed, same_band): how an estimate agrees with what came of it; no correlation under 3 rows or without spread."""
    ranked = average_ranks(average_ranks(df, key, estimate, "_e"), key, actual, "_a")
    sure = lambda a, b: F.when((F.count("*") >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))
    off = F.col(estimate) - F.col(actual)
    same = (band(F.col(estimate)) == band(F.col(actual))).cast("double")
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), sure(estimate, actual).alias("pearson"), sure("_e", "_a").alias("spearman"), F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("signed"), F.avg(same).alias("same_band"))


def bootstrap(counts: DataFrame, key: list[str], unit: str, k: str, n: str, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """(key, rate, low, high): sum(k) / sum(n) over units with a percentile interval from Poisson resamples.

    Each unit counts in each resample as often as a Poisson(1) draw from its hash says, so units need not meet. A resample
    in which a key has nothing counted is left out; a key without counts has null rates.
    """
    u = (F.pmod(F.xxhash64(unit, "draw"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges, term, total = [], 0.36787944117144233, 0.0
    for i in range(12):
        total += term
        edges.append(total)
        term /= i + 1
    weight = sum((F.when(u > e, 1).otherwise(0) for e in edges), F.lit(0))
    drawn = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    rates = drawn.groupBy(*key, "draw").agg(F.try_divide(F.sum(F.col(k) * F.col("w")), F.sum(F.col(n) * F.col("w"))).alias("r"))
    tail = (1 - level) / 2
    ends = rates.groupBy(*key).agg(F.percentile("r", F.lit(tail)).alias("low"), F.percentile("r", F.lit(1 - tail)).alias("high"))
    return counts.groupBy(*key).agg(F.try_divide(F.sum(k), F.sum(n)).alias("rate")).join(ends, key)


def merged_counters(rows: DataFrame, key: list[str], counters: list[str], kinds: str) -> DataFrame:
    """(key, counters, kinds): counters added up, and a map of counts by name added up by name."""
    sums = rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in counters))
    each = rows.select(*key, F.explode(kinds).alias("name", "n")).groupBy(*key, "name").agg(F.sum("n").alias("n"))
    maps = each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(kinds))
    return sums.join(maps, key, "left")


def pooled_rates(counters: DataFrame, key: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, metric, k, n, rate): each metric's counters added up over the key, a null rate where nothing was counted.

    A key column may have one of the result's names; then the result's column has an underscore before it.
    """
    sums = counters.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sorted({c for p in pairs.values() for c in p})))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(k).cast("long").alias("k"), F.col(n).cast("long").alias("n")) for m, (k, n) in pairs.items()))
    named = lambda c: f"_{c}" if c in key else c
    each = sums.select(*key, F.explode(rows).alias("_row"))
    rate = F.when(F.col("_row.n") > 0, F.round(F.col("_row.k") / F.col("_row.n"), 4))
    return each.select(*key, *(F.col(f"_row.{c}").alias(named(c)) for c in ("metric", "k", "n")), rate.alias(named("rate")))


def scorecards(metrics: DataFrame, outer: str, middle: str, inner: str, value: str) -> DataFrame:
    """(outer, cards): values nested by middle, then inner, each sorted."""
    rows = metrics.groupBy(outer, middle).agg(F.array_sort(F.collect_list(F.struct(inner, value))).alias("rows"))
    return rows.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(middle, "rows"))).alias("cards"))


def sentences(groups: DataFrame, key: list[str], class_col: str, n: str, confidence: str) -> DataFrame:
    """(key, sentence): 'class: n (max confidence 0.00)' of each class, sorted, parted by semicolons."""
    part = F.concat(F.col(class_col), F.lit(": "), F.col(n).cast("string"), F.when(F.col(confidence).isNotNull(), F.format_string(" (max confidence %.2f)", F.col(confidence))).otherwise(""))
    return groups.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("sentence"))
