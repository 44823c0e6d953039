"""Queries of the carver, framed streams, chains, order, suppression and logs; streams are written from table values and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bits, canonical, carving, crosscheck, external, framing, identify, listing, measuring, ordering, partitions, placement, pointers, records, suppression
from ..session import sliced
from ..sources import images
from . import bindings as b
from .catalog import query

#: Small chunks and blocks, so that the small tables have units, clips and frames that lie across several.
CHUNK, BLOCK, SPAN = 1024, 4096, 1 << 16


def byte_text(value: Column, size: int, little: bool = False) -> Column:
    """The hex text of an unsigned integer of so many bytes."""
    order = range(size) if little else range(size - 1, -1, -1)
    return F.concat(*(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in order))


def golomb(value: Column) -> Column:
    """The bits of an unsigned Exp-Golomb number, as text."""
    code = F.bin(value.cast("long") + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def packed(text: Column) -> Column:
    """Bits as bytes, behind them a stop bit and zeros."""
    whole = F.concat(text, F.lit("1"))
    n = F.ceil(F.length(whole) / 8).cast("int")
    full = F.rpad(whole, n * 8, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lpad(F.conv(F.substring(full, k * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))


@query("SELECT p_partkey AS id, true AS valid, CAST(p_partkey % 32 AS INT) AS set_id, CAST(4 + p_partkey % 13 AS INT) AS frame_num_bits, CAST(p_size AS INT) AS width, CAST(1 + p_partkey % 1000 AS INT) AS height FROM part")
def sequence_parameters(spark: SparkSession, d: str) -> DataFrame:
    """An H.264 sequence parameter set for each part, of its numbers, written and read."""
    k = F.col("p_partkey")
    text = F.concat(golomb(k % 32), golomb(k % 13), golomb(F.lit(2)), golomb(F.lit(1)), F.lit("0"), golomb(F.col("p_size") - 1), golomb(k % 1000), F.lit("1100"))
    raw = F.concat(F.unhex(F.lit("6742001E")), packed(text))
    units = b.table(spark, d, "part").select(k.alias("id"), raw.alias("raw"), F.lit("h264").alias("codec"), F.lit("sps").alias("part"))
    p = "parameter"
    return bits.parameter_sets(units).select("id", f"{p}.valid", F.col(f"{p}.id").alias("set_id"), f"{p}.frame_num_bits", f"{p}.width", f"{p}.height")


# ---- clips: a stream for each user, its events as pictures


#: Parameter sets of 20 x 15 macroblocks, as written by hand; both need no escapes.
SETS = "0000000167" + "42001EDB0507E4" + "0000000168" + "CE3880"
_STREAM = """b_pic AS (SELECT user_id AS img, event_id, event_type = 'signup' AS access, value > 80 AS gap, event_type = 'error' AND value < 30 AS jump, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
b_len AS (SELECT *, CASE WHEN gap THEN 100 ELSE 0 END AS pad, CASE WHEN access THEN 20 ELSE 0 END + 4 + 3 + 20 AS len, sum(CASE WHEN gap THEN 100 ELSE 0 END + CASE WHEN access THEN 20 ELSE 0 END + 27) OVER (PARTITION BY img ORDER BY k) AS stop FROM b_pic),
b_state AS (SELECT *, coalesce(max(CASE WHEN access THEN k END) OVER w, 0) AS opened, coalesce(max(CASE WHEN gap OR (jump AND NOT access) THEN k END) OVER w, 0) AS broken FROM b_len WINDOW w AS (PARTITION BY img ORDER BY k)),
b_on AS (SELECT *, opened > 0 AND opened >= broken AS on_, coalesce(lag(opened > 0 AND opened >= broken) OVER (PARTITION BY img ORDER BY k), false) AS was FROM b_state),
b_cut AS (SELECT *, sum(CASE WHEN (on_ AND (NOT was OR gap)) OR (NOT on_ AND (was OR gap OR k = 1)) THEN 1 ELSE 0 END) OVER (PARTITION BY img ORDER BY k) AS piece FROM b_on)"""


def streams(spark: SparkSession, d: str) -> DataFrame:
    """(img, bytes): events of a user in order. Sign-ups are random-access pictures behind parameter sets; some errors jump in
    their frame numbers; some events lie behind 100 zeros."""
    e = b.table(spark, d, "events")
    along = W.partitionBy("user_id").orderBy("event_id")
    access = F.col("event_type") == "signup"
    rows = e.select("user_id", "event_id", access.alias("access"), (F.col("value") > 80).alias("gap"), ((F.col("event_type") == "error") & (F.col("value") < 30)).alias("jump"))
    rows = rows.withColumns({"k": F.row_number().over(along), "opened": F.max(F.when(F.col("access"), F.col("event_id"))).over(along)})
    own = W.partitionBy("user_id", "opened").orderBy("event_id")
    jumps = F.sum(F.when(F.col("jump") & ~F.col("access"), 4).otherwise(0)).over(own)
    number = F.pmod(F.row_number().over(own) - 1 + jumps, F.lit(16))
    # first macroblock 0, slice type 7 or 5, parameter set 0, the number in 4 bits, then ones; bytes without zeros behind
    head = F.when(F.col("access"), F.concat(F.lit("65"), byte_text(F.lit(0b1000100010000000) + number * 8 + 7, 2))).otherwise(F.concat(F.lit("41"), byte_text(F.lit(0b1001101000000000) + number * 32 + 31, 2)))
    unit = F.concat(F.when(F.col("gap"), "00" * 100).otherwise(""), F.when(F.col("access"), SETS).otherwise(""), F.lit("00000001"), head, F.lit("A5" * 20))
    rows = rows.withColumn("unit", unit)
    return rows.groupBy(F.col("user_id").alias("img")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "unit"))), lambda x: x["unit"]), "")).alias("bytes"))


@query(f"""SELECT img, CASE WHEN on_ THEN 'clip' ELSE 'orphan' END AS kind, CAST(min(stop - len) AS BIGINT) AS s, CAST(max(stop) AS BIGINT) AS e, CAST(count(*) + CASE WHEN on_ THEN 2 * count(*) FILTER (access) ELSE 0 END AS BIGINT) AS units,
CASE WHEN on_ THEN count(*) ELSE 0 END AS pictures, CASE WHEN on_ THEN count(*) FILTER (access) ELSE 0 END AS random_access FROM b_cut GROUP BY img, piece, on_""", _STREAM)
def stream_clips(spark: SparkSession, d: str) -> DataFrame:
    found = carving.carve(images.chunked(streams(spark, d), CHUNK, carving.RAW), block=BLOCK, span=SPAN)
    return found.select("img", "kind", F.col("extents")[0]["s"].alias("s"), F.col("extents")[0]["e"].alias("e"), "units", "pictures", "random_access")


@query("SELECT img, count(*) + 2 * count(*) FILTER (access) AS units, CAST(sum(len) AS BIGINT) AS bytes FROM b_len GROUP BY img", _STREAM)
def stream_units(spark: SparkSession, d: str) -> DataFrame:
    units = carving.nal_units(images.chunked(streams(spark, d), CHUNK, carving.RAW), SPAN)
    return units.groupBy("img").agg(F.count("*").alias("units"), F.sum(F.col("end") - F.col("at")).alias("bytes"))


# ---- framed streams: a frame for each event


_FRAMES = """b_frame0 AS (SELECT user_id AS img, event_id % 3 AS channel, event_id, CASE event_type WHEN 'signup' THEN 253 WHEN 'view' THEN 240 ELSE 252 END AS type, event_type = 'error' AND value > 60 AS bad, 35 + event_id % 5 AS length FROM events),
b_frame AS (SELECT *, sum(length) OVER w - length AS "at", row_number() OVER (PARTITION BY img, channel ORDER BY event_id) AS number, coalesce(max(CASE WHEN bad THEN event_id END) OVER w, -1) AS last_bad FROM b_frame0 WINDOW w AS (PARTITION BY img ORDER BY event_id)),
b_run AS (SELECT *, min("at") OVER (PARTITION BY img, last_bad) AS run FROM b_frame WHERE NOT bad)"""


def framed(spark: SparkSession, d: str) -> DataFrame:
    """(img, bytes): a DHAV frame for each event of a user; some errors have another trailer."""
    e = b.table(spark, d, "events")
    number = F.row_number().over(W.partitionBy("user_id", F.col("event_id") % 3).orderBy("event_id"))
    rows = e.select("user_id", "event_id", "event_type", number.alias("number"), (F.col("event_id") % 3).alias("channel"), ((F.col("event_type") == "error") & (F.col("value") > 60)).alias("bad"), (35 + F.col("event_id") % 5).alias("length"))
    kind = F.when(F.col("event_type") == "signup", "FD").when(F.col("event_type") == "view", "F0").otherwise("FC")
    head = F.concat(F.lit("44484156"), kind, F.lit("01"), byte_text(F.col("channel"), 1), F.lit("00"), byte_text(F.col("number"), 4, True), byte_text(F.col("length"), 4, True), F.lit("00000000" + "0000" + "00" + "00"))
    tail = F.concat(F.lit("64686176"), byte_text(F.col("length") - F.when(F.col("bad"), 9).otherwise(8), 4, True))
    rows = rows.select("user_id", F.col("event_id").alias("k"), F.concat(head, F.repeat(F.lit("5A"), (F.col("length") - 32).cast("int")), tail).alias("frame"))
    return rows.groupBy(F.col("user_id").alias("img")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "frame"))), lambda x: x["frame"]), "")).alias("bytes"))


def met_frames(spark: SparkSession, d: str) -> DataFrame:
    return framing.frames(images.chunked(framed(spark, d), CHUNK, framing.OVERLAP), SPAN)[0]


@query("""SELECT img, CAST("at" AS BIGINT) AS "at", CAST(run AS BIGINT) AS run, CAST(type AS INT) AS type, CAST(channel AS INT) AS channel, number, CAST("at" + 24 AS BIGINT) AS p0, CAST("at" + length - 8 AS BIGINT) AS p1 FROM b_run""", _FRAMES)
def frame_chains(spark: SparkSession, d: str) -> DataFrame:
    return met_frames(spark, d).where("reason is null").select("img", "at", "run", "type", "channel", "number", "p0", "p1")


@query("SELECT img, 'trailer missing or length mismatch' AS reason, CAST(sum(CASE WHEN after THEN 2 ELSE 1 END) AS BIGINT) AS n FROM (SELECT img, bad, coalesce(NOT lag(bad) OVER (PARTITION BY img ORDER BY event_id), false) AS after FROM b_frame) t WHERE bad GROUP BY img", _FRAMES)
def frame_rejections(spark: SparkSession, d: str) -> DataFrame:
    return framing.rejections(met_frames(spark, d))


@query("""SELECT img, CAST(channel AS INT) AS channel, CAST(min("at") + 24 AS BIGINT) AS s, CAST(max("at" + length) - 8 AS BIGINT) AS e, count(*) AS frames, count(*) FILTER (type = 253) AS keys, CASE WHEN max(next_cut) THEN 'frame_number discontinuity' ELSE 'end of contiguous DHAV frame run' END AS reason
FROM (SELECT *, sum(CASE WHEN type = 253 AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY img, run, channel ORDER BY event_id) AS clip FROM (SELECT *, coalesce(bool_or(type = 253) OVER (PARTITION BY img, run, channel, part ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS on_, coalesce(bool_or(type = 253) OVER (PARTITION BY img, run, channel, part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was, coalesce(lead(cut) OVER (PARTITION BY img, run, channel ORDER BY event_id), false) AS next_cut
FROM (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY img, run, channel ORDER BY event_id) AS part FROM (SELECT *, coalesce(number - lag(number) OVER (PARTITION BY img, run, channel ORDER BY event_id) > 4, false) AS cut FROM b_run WHERE type <> 240) a) c) v) w WHERE on_ GROUP BY img, channel, run, part, clip""", _FRAMES)
def frame_clips(spark: SparkSession, d: str) -> DataFrame:
    return framing.channel_clips(met_frames(spark, d), span=SPAN).where("kind = 'clip'").select("img", "channel", "s", "e", "frames", "keys", "reason")


# ---- chains of retries


@query("""SELECT j.id, w.pos AS latest, w.steps AS attempts FROM b_job j JOIN (SELECT id, arg_max(pos, steps) AS pos, max(steps) AS steps FROM b_walk GROUP BY id) w USING (id)""",
    "b_job AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey > 3 THEN o_orderkey - 1 - o_orderkey % 3 END AS retry_of FROM orders)", "b_next AS (SELECT retry_of AS id, max(id) AS n FROM b_job WHERE retry_of IS NOT NULL GROUP BY 1)",
    "b_walk AS (SELECT id, id AS pos, 0::BIGINT AS steps FROM b_job UNION ALL SELECT w.id, n.n, w.steps + 1 FROM b_walk w JOIN b_next n ON n.id = w.pos JOIN b_job j ON j.id = n.n)")
def retry_chains(spark: SparkSession, d: str) -> DataFrame:
    """Orders that retry one of the few orders before them."""
    k = F.col("o_orderkey")
    jobs = b.table(spark, d, "orders").select(k.alias("id"), F.when((k % 7 != 0) & (k > 3), k - 1 - k % 3).alias("retry_of"))
    return pointers.latest_attempts(jobs).select("id", "latest", "attempts")


# ---- order


#: Instants around 1970, so that half of them are negative; a start is uncertain by up to some minutes.
SHIFT = 1_705_000_000_000_000
_BARS = f"""b_bar AS (SELECT event_id AS clip_id, user_id % 8 AS evidence_id, CASE WHEN user_id % 17 <> 0 THEN user_id % 4 END AS channel, CASE WHEN user_id % 5 <> 0 THEN epoch_us(ts) - {SHIFT} END AS start_lo,
  epoch_us(ts) - {SHIFT} + CAST(floor(value) AS BIGINT) % 7 * 100000000 AS start_hi, epoch_us(ts) - {SHIFT} + CAST(floor(value) AS BIGINT) * 10000000 + 700000000 AS end_lo, epoch_us(ts) - {SHIFT} + CAST(floor(value) AS BIGINT) * 10000000 + 700000000 + event_id % 3 * 1000000 AS end_hi FROM events),
b_placed AS (SELECT *, row_number() OVER (ORDER BY start_lo + start_hi, end_lo + end_hi, evidence_id, channel IS NULL, channel, clip_id) AS "order" FROM b_bar WHERE start_lo IS NOT NULL)"""
_BEYOND = """b_beyond AS (SELECT a."order" AS o, coalesce((SELECT min(x."order") FROM b_placed x WHERE x."order" > a."order" AND x.start_lo > a.start_hi), (SELECT max("order") + 1 FROM b_placed)) AS beyond FROM b_placed a)"""


def bars(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    at, v = F.unix_micros(F.col("ts").cast("timestamp")) - SHIFT, F.floor("value").cast("long")
    end = at + v * 10_000_000 + 700_000_000
    return e.select(F.col("event_id").alias("clip_id"), (F.col("user_id") % 8).alias("evidence_id"), F.when(F.col("user_id") % 17 != 0, F.col("user_id") % 4).alias("channel"), F.when(F.col("user_id") % 5 != 0, at).alias("start_lo"), (at + v % 7 * 100_000_000).alias("start_hi"), end.alias("end_lo"), (end + F.col("event_id") % 3 * 1_000_000).alias("end_hi"))


@query('SELECT clip_id, "order" FROM b_placed', _BARS)
def order_of_clips(spark: SparkSession, d: str) -> DataFrame:
    return ordering.bars_in_order(bars(spark, d)).select("clip_id", "order")


@query('SELECT a.clip_id AS a, x.clip_id AS b FROM b_placed a JOIN b_beyond y ON y.o = a."order" JOIN b_placed x ON x."order" > a."order" AND x."order" < y.beyond', _BARS, _BEYOND)
def ambiguous_order(spark: SparkSession, d: str) -> DataFrame:
    return ordering.ambiguous_order(ordering.bars_in_order(bars(spark, d)))


@query("""SELECT evidence_id, channel, clip_id AS a, nc AS b, (ns + nh - end_lo - end_hi) / 2 AS nominal, ns - end_hi AS least, nh - end_lo AS most, ns - end_hi > 0 AS certain
FROM (SELECT *, lead(clip_id) OVER w AS nc, lead(start_lo) OVER w AS ns, lead(start_hi) OVER w AS nh FROM b_placed WINDOW w AS (PARTITION BY evidence_id, channel ORDER BY "order")) t WHERE ns + nh - end_lo - end_hi > 2000000""", _BARS)
def uncertain_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ordering.bar_gaps(ordering.bars_in_order(bars(spark, d)))


@query("""SELECT a.clip_id AS a, x.clip_id AS b, CASE WHEN a.evidence_id = x.evidence_id AND a.channel IS NOT DISTINCT FROM x.channel THEN 'same_channel' ELSE 'cross_channel' END AS type,
(least(a.end_lo + a.end_hi, x.end_lo + x.end_hi) - x.start_lo - x.start_hi) / 2 AS nominal, greatest(0, least(a.end_lo, x.end_lo) - greatest(a.start_hi, x.start_hi)) AS sure, least(a.end_lo, x.end_lo) > greatest(a.start_hi, x.start_hi) AS certain
FROM b_placed a JOIN b_placed x ON x."order" > a."order" AND x.start_lo + x.start_hi < a.end_lo + a.end_hi WHERE x.start_lo + x.start_hi < x.end_lo + x.end_hi AND a.start_lo + a.start_hi < a.end_lo + a.end_hi""", _BARS)
def uncertain_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return ordering.bar_overlaps(ordering.bars_in_order(bars(spark, d)))


_KNOWN = {"clip_id": "CAST(clip_id AS VARCHAR)", "evidence_id": "CAST(evidence_id AS VARCHAR)", "channel": "coalesce(CAST(channel AS VARCHAR), '')"}


def _export_sql(line: str, placement: str, source: str, order: str, listed: str, reason: str) -> str:
    own = _KNOWN | {"placement": f"'{placement}'", "order": order, "unplaceable_reason": reason, "ambiguous_order_with": listed}
    return f"SELECT {line} AS line, " + ", ".join(f'{own.get(c, chr(39) * 2)} AS "{c}"' for c in ordering.EXPORT) + f" FROM {source}"


@query(_export_sql('"order"', "placed", "b_placed LEFT JOIN b_list USING (clip_id)", 'CAST("order" AS VARCHAR)', "coalesce(names, '')", "''") + " UNION ALL " + _export_sql(f"{1 << 62} + row_number() OVER (ORDER BY clip_id)", "unplaceable", "b_bar WHERE start_lo IS NULL", "''", "''", "'timezone_unknown'"),
    _BARS, _BEYOND, """b_amb AS (SELECT a.clip_id AS a, x.clip_id AS b, a."order" AS oa, x."order" AS ob FROM b_placed a JOIN b_beyond y ON y.o = a."order" JOIN b_placed x ON x."order" > a."order" AND x."order" < y.beyond)""",
    "b_list AS (SELECT clip_id, string_agg(CAST(other AS VARCHAR), ';' ORDER BY o) AS names FROM (SELECT a AS clip_id, b AS other, ob AS o FROM b_amb UNION ALL SELECT b, a, oa FROM b_amb) t GROUP BY clip_id)")
def timeline_export(spark: SparkSession, d: str) -> DataFrame:
    """The 49 columns of the export, in its line order."""
    all_bars = bars(spark, d)
    ordered = ordering.bars_in_order(all_bars)
    lost = all_bars.where("start_lo is null").select("clip_id", "evidence_id", "channel", F.lit("timezone_unknown").alias("unplaceable_reason"))
    return ordering.export_rows(ordering.ambiguous_lists(ordered).select("clip_id", "evidence_id", "channel", "order", "ambiguous_order_with"), lost)


# ---- boxes


_BOXES = """b_box AS (SELECT event_id AS id, user_id AS img, event_type AS class_name, round(value / 100, 2) AS score, event_id % 23 * 4.0 - 40 AS x1, event_id % 19 * 3.0 - 20 AS y1, event_id % 23 * 4.0 - 40 + 4 + event_id % 7 * 3 AS x2, event_id % 19 * 3.0 - 20 + 4 + event_id % 5 * 3 AS y2 FROM events)"""
_IOU = "(greatest(0, least(k.x2, x.x2) - greatest(k.x1, x.x1)) * greatest(0, least(k.y2, x.y2) - greatest(k.y1, x.y1)))"


@query(f"""SELECT img, class_name, unnest(list_transform(kept, lambda k: k.id)) AS id FROM (SELECT img, class_name, list_reduce(rws, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {_IOU} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_IOU}) > 0.2)) > 0 THEN kept ELSE kept || x END, []) AS kept
FROM (SELECT img, class_name, list([{{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, id) AS rws FROM b_box GROUP BY img, class_name) t) u""".replace("least(k.x2, x.x2)", "least(k.x2, x[1].x2)").replace("greatest(k.x1, x.x1)", "greatest(k.x1, x[1].x1)").replace("least(k.y2, x.y2)", "least(k.y2, x[1].y2)").replace("greatest(k.y1, x.y1)", "greatest(k.y1, x[1].y1)"), _BOXES)
def suppressed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of each user and event type that greedy suppression keeps."""
    k = F.col("event_id")
    x, y = (k % 23) * 4.0 - 40, (k % 19) * 3.0 - 20
    boxes = b.table(spark, d, "events").select(k.alias("id"), F.col("user_id").alias("img"), F.col("event_type").alias("class_name"), measuring.rounded(F.col("value") / 100, 2).alias("score"), x.alias("x1"), y.alias("y1"), (x + 4 + k % 7 * 3).alias("x2"), (y + 4 + k % 5 * 3).alias("y2"))
    return suppression.suppress(boxes, ["img", "class_name"], 0.2)[0].select("img", "class_name", "id")


# ---- logs


def canonical_log(spark: SparkSession, d: str) -> DataFrame:
    """A log for each customer, hashed over canonical JSON; every 97th order's details changed since, every 89th taken out, every 83rd torn."""
    log = b.log(spark, d).withColumn("n", F.length("payload"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "case_id", "order_id", "n")))
    text = lambda x, prev: F.concat(F.lit('{"action":"note","case_id":'), x["case_id"].cast("string"), F.lit(',"details":{"a":'), x["n"].cast("string"), F.lit(',"order":'), x["order_id"].cast("string"), F.lit('},"evidence_id":null,"examiner":"E","ntp_status":"ok","prev_hash":"'), prev, F.lit('","seq":'), x["seq"].cast("string"), F.lit(',"timestamp_utc":"t","tool_version":"1","v":1}'))
    start = F.array(F.struct(F.lit(records.GENESIS).alias("entry_hash"), F.lit("").alias("prev_hash"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("order_id"), F.lit(0).alias("n")))
    last = lambda acc: F.element_at(acc, -1)["entry_hash"]
    step = lambda acc, x: F.concat(acc, F.array(F.struct(F.sha2(text(x, last(acc)), 256).alias("entry_hash"), last(acc).alias("prev_hash"), x["seq"].alias("seq"), x["order_id"].alias("order_id"), x["n"].alias("n"))))
    written = log.groupBy("case_id").agg(rows.alias("rows")).select("case_id", F.inline(F.aggregate("rows", start, step))).where("seq > 0")
    details = F.concat(F.lit('{ "order": '), F.col("order_id").cast("string"), F.lit(', "a": '), (F.col("n") + F.when(F.col("order_id") % 97 == 0, 1).otherwise(0)).cast("string"), F.when(F.col("order_id") % 83 == 0, "").otherwise("}"))
    plain = {"timestamp_utc": "t", "action": "note", "examiner": "E", "tool_version": "1", "ntp_status": "ok"}
    return written.where("order_id % 89 <> 0").select("case_id", F.col("seq").cast("long").alias("seq"), *(F.lit(v).alias(c) for c, v in plain.items()), F.lit(None).cast("long").alias("evidence_id"), details.alias("details_json"), "prev_hash", "entry_hash", F.when(F.col("order_id") % 79 == 0, "old").otherwise("k1").alias("key_id"))


@query("""SELECT case_id, CAST(seq AS BIGINT) AS seq, 'sequence gap or reorder (expected ' || due || ')' AS reason FROM b_seen WHERE seq <> due UNION ALL SELECT case_id, seq, 'prev_hash does not match previous entry_hash' FROM b_seen WHERE seq - 1 <> before
UNION ALL SELECT case_id, seq, 'details not parseable' FROM b_seen WHERE order_id % 83 = 0 UNION ALL SELECT case_id, seq, 'entry_hash does not match entry contents' FROM b_seen WHERE order_id % 97 = 0 AND order_id % 83 <> 0 UNION ALL SELECT case_id, seq, 'signed with unknown key old' FROM b_seen WHERE order_id % 79 = 0""",
    b.LOG, "b_seen AS (SELECT case_id, seq, order_id, row_number() OVER w AS due, coalesce(lag(seq) OVER w, 0) AS before FROM b_log WHERE order_id % 89 <> 0 WINDOW w AS (PARTITION BY case_id ORDER BY seq))")
def log_faults(spark: SparkSession, d: str) -> DataFrame:
    return canonical.chain_report(canonical_log(spark, d), "k1")




# ---- vendor lists, page trees, partition tables, the index


@query("SELECT CAST(img AS BIGINT) AS img, CAST(k - 1 AS BIGINT) AS n, epoch_us(o_orderdate) // 1000000 AS start, k % 256 AS block, img % 256 AS grp, o_orderkey % 13 <> 0 AS valid FROM (SELECT *, o_custkey // 16 AS img, row_number() OVER (PARTITION BY o_custkey // 16 ORDER BY o_orderkey) AS k, min(CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey // 16) AS blank FROM orders) t WHERE blank IS NULL OR o_orderkey < blank")
def vendor_block_list(spark: SparkSession, d: str) -> DataFrame:
    """A block list for the orders of 16 customers; an order in 13 has reserved bytes set, one in 101 is blank and ends its list."""
    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(F.expr("o_custkey div 16").alias("img"), k.alias("k"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t")).withColumn("n", F.row_number().over(W.partitionBy("img").orderBy("k")))
    entry = F.concat(byte_text(F.when(F.col("k") % 13 == 0, 9).otherwise(0), 4, True), byte_text(F.col("t"), 4, True), F.lit("4D000000"), byte_text(F.col("n") % 256, 1), byte_text(F.col("img") % 256, 1), F.lit("0000"))
    text = rows.select("img", "n", F.when(F.col("k") % 101 == 0, "00" * 16).otherwise(entry).alias("entry"))
    image = text.groupBy("img").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "")).alias("bytes"))
    chunks = images.chunked(image, CHUNK)
    return listing.block_list(chunks, (631_152_000, 4_102_444_800), -listing.BLOCKS)


#: A partition table for each customer: the sectors of its first orders as partitions.
_GUID_TABLE = """b_part AS (SELECT o_custkey AS img, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS entry, o_orderkey % 90 AS first, o_orderkey % 90 + o_orderkey % 31 - 2 AS last, o_orderpriority AS name FROM orders),
b_size AS (SELECT img, 128 * 512 AS size FROM (SELECT DISTINCT img FROM b_part) t)"""


def partitioned_images(spark: SparkSession, d: str) -> DataFrame:
    """(img, bytes): 128 sectors with a GUID table of 64 entries; each 7th customer's header and each 11th's array is spoilt, each 5th lacks its backup."""
    import struct
    import zlib

    import pyarrow as pa

    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("img"), k.alias("k"), (k % 90).alias("first"), (k % 90 + k % 31 - 2).alias("last"), F.col("o_orderpriority").alias("name"))
    each = rows.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("k", "first", "last", "name"))).alias("parts"))

    def run(batches):  # noqa: ANN001, ANN202
        for t in sliced(batches, 1 << 16):  # an image is many times as long as its row
            out = []
            for img, parts in zip(t.column("img").to_pylist(), t.column("parts").to_pylist()):
                entries = b"".join(bytes(range(1, 17)) + struct.pack("<QQ", p["k"], 0) + struct.pack("<QQQ", p["first"], max(0, p["last"]), 0) + p["name"].encode("utf-16-le").ljust(72, b"\0") for p in parts[:64]).ljust(64 * 128, b"\0")
                head = bytearray(b"EFI PART" + struct.pack("<IIIIQQQQ", 0x10000, 92, 0, 0, 1, 127, 34, 120) + struct.pack("<QQ", img, 1) + struct.pack("<QIII", 2, 64, 128, zlib.crc32(entries) ^ (img % 11 == 0)))
                head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)) ^ (img % 7 == 0))
                out.append((bytes(512) + bytes(head)).ljust(1024, b"\0") + entries + bytes(512 * 109) + (b"EFI PART" if img % 5 else b"").ljust(512, b"\0"))
            yield pa.RecordBatch.from_arrays([t.column("img"), pa.array(out, pa.binary())], ["img", "bytes"])

    return each.mapInArrow(run, "img long, bytes binary")


@query("SELECT img, CAST(entry AS INT) AS entry, CAST(first * 512 AS BIGINT) AS s, CAST((greatest(0, last) + 1) * 512 AS BIGINT) AS e, name FROM b_part WHERE entry < 64", _GUID_TABLE)
def guid_partitions(spark: SparkSession, d: str) -> DataFrame:
    _, parts, _ = partitions.read_tables(images.chunked(partitioned_images(spark, d), CHUNK))
    return parts.select("img", "entry", "s", "e", "name")


@query("""SELECT img, 'gpt_header_crc_mismatch' AS kind, CAST(NULL AS INT) AS entry, CAST(512 AS BIGINT) AS at_ FROM b_size WHERE img % 7 = 0 UNION ALL SELECT img, 'gpt_entries_crc_mismatch', NULL, 1024 FROM b_size WHERE img % 11 = 0 UNION ALL SELECT img, 'gpt_backup_header_missing', NULL, 127 * 512 FROM b_size WHERE img % 5 = 0
UNION ALL SELECT img, 'gpt_partition_negative_length', CAST(entry AS INT), first * 512 FROM b_part WHERE entry < 64 AND greatest(0, last) < first UNION ALL SELECT img, 'gpt_partition_beyond_image', CAST(entry AS INT), first * 512 FROM b_part WHERE entry < 64 AND (greatest(0, last) + 1) * 512 > 65536""", _GUID_TABLE)
def guid_anomalies(spark: SparkSession, d: str) -> DataFrame:
    _, _, bad = partitions.read_tables(images.chunked(partitioned_images(spark, d), CHUNK))
    return bad.select("img", "kind", "entry", F.col("at").alias("at_"))


@query("""SELECT coalesce(s.id, t.top + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY f.run, f.line, f.part)) AS id, f.run, f.line, f.part, f.text FROM b_fresh f LEFT JOIN b_stored s ON s.run = f.run AND s.line = f.line AND s.part = f.part CROSS JOIN (SELECT max(id) AS top FROM b_stored) t""",
    "b_line AS (SELECT l_orderkey AS run, l_linenumber AS line, l_partkey AS part, max(l_returnflag) AS text FROM lineitem GROUP BY 1, 2, 3)", "b_stored AS (SELECT row_number() OVER (ORDER BY run, line, part) AS id, * FROM b_line WHERE run % 3 <> 0)", "b_fresh AS (SELECT run, line, part, text || '!' AS text FROM b_line WHERE run % 4 <> 0)")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of the lines of two orders in three, brought up to date with those of three in four."""
    line = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).agg(F.max("l_returnflag").alias("text"))
    stored = ordering.total_order(line.where("run % 3 <> 0"), [F.col("run"), F.col("line"), F.col("part")], "id")
    rows, _ = placement.upserted(stored, line.where("run % 4 <> 0").withColumn("text", F.concat("text", F.lit("!"))), ["run", "line", "part"])
    return rows.select("id", "run", "line", "part", "text")


# ---- other sources


_CROSS = """b_parsed AS (SELECT o_custkey AS img, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'h264' ELSE 'h265' END AS codec, o_orderkey % 5 AS frames, o_orderkey % 9 <> 0 AS exportable, o_orderkey * 1000 AS s, o_orderkey * 1000 + 500 + o_custkey % 100 AS e FROM orders),
b_carved AS (SELECT o_custkey AS img, o_orderkey * 10 AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN 'h264' ELSE 'h265' END AS codec, o_orderkey % 5 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS frames, o_orderkey * 1000 + o_orderkey % 8 * 90 AS s, o_orderkey * 1000 + o_orderkey % 8 * 90 + 400 + o_orderkey % 3 * 60 AS e FROM orders),
b_over AS (SELECT p.img, p.id, g.id AS r, least(p.e, g.e) - greatest(p.s, g.s) AS o FROM b_parsed p JOIN b_carved g ON p.img = g.img AND p.s < g.e AND g.s < p.e),
b_most AS (SELECT img, id, arg_min(r, {'o': -o, 'r': r}) AS r, max(o) AS o FROM b_over GROUP BY 1, 2),
b_own AS (SELECT p.*, CASE WHEN m.o >= 0.5 * (p.e - p.s) THEN m.r END AS r, m.o FROM b_parsed p LEFT JOIN b_most m USING (img, id) WHERE exportable),
b_both AS (SELECT w.*, g.codec AS gc, g.frames AS gf, g.e - g.s AS gsize FROM b_own w JOIN b_carved g ON g.img = w.img AND g.id = w.r)"""


@query("""SELECT img, 'parser_clip_not_found_by_generic' AS kind, id AS parser_clip, CAST(NULL AS BIGINT) AS carver_clip, CAST(e - s AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS found FROM b_own WHERE r IS NULL
UNION ALL SELECT img, 'codec_mismatch', id, r, codec, gc FROM b_both WHERE codec <> gc UNION ALL SELECT img, 'frame_count_mismatch', id, r, CAST(frames AS VARCHAR), CAST(gf AS VARCHAR) FROM b_both WHERE frames <> gf
UNION ALL SELECT img, 'generic_includes_extra_bytes', id, r, '0', CAST(gsize - o AS VARCHAR) FROM b_both WHERE gsize - o > 0.02 * gsize
UNION ALL SELECT g.img, 'generic_clip_not_explained_by_parser', NULL, g.id, CAST(g.e - g.s AS VARCHAR), NULL FROM b_carved g WHERE NOT EXISTS (SELECT 1 FROM b_over o WHERE o.img = g.img AND o.r = g.id)""", _CROSS)
def parser_against_carver(spark: SparkSession, d: str) -> DataFrame:
    """A clip for each order as a parser and as the carver would see it, some moved so far that they miss each other."""
    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    one = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e"))).alias("extents")
    done = F.col("o_orderstatus") == "F"
    parsed = o.select(F.col("o_custkey").alias("img"), k.alias("id"), F.when(done, "h264").otherwise("h265").alias("codec"), (k % 5).alias("frames"), (k % 9 != 0).alias("exportable"), one(k * 1000, k * 1000 + 500 + F.col("o_custkey") % 100))
    moved = k * 1000 + k % 8 * 90
    carved = o.select(F.col("o_custkey").alias("img"), (k * 10).alias("id"), F.when(done & (k % 4 != 0), "h264").otherwise("h265").alias("codec"), (k % 5 + F.when(k % 6 == 0, 1).otherwise(0)).alias("frames"), one(moved, moved + 400 + k % 3 * 60))
    return crosscheck.disagreements(parsed, carved, 1024)


@query("""SELECT id, CASE WHEN bool_or(a >= day * 86400000000 + 79200000000 AND z <= day * 86400000000 + 93600000000) THEN 'within' ELSE 'overlaps_boundary' END AS verdict
FROM (SELECT id, a, z, unnest(range(a // 86400000000 - 1, z // 86400000000 + 1)) AS day FROM (SELECT id, epoch_us(timezone('Europe/Berlin', timezone('UTC', make_timestamp(lo)))) AS a, epoch_us(timezone('Europe/Berlin', timezone('UTC', make_timestamp(hi + 600000000)))) AS z FROM b_event WHERE lo IS NOT NULL) u) t
WHERE a <= day * 86400000000 + 93600000000 AND z >= day * 86400000000 + 79200000000 GROUP BY id""", b.EVENTS)
def zoned_nights(spark: SparkSession, d: str) -> DataFrame:
    """From 22:00 to 02:00 in Berlin; an event's instant is uncertain by ten minutes."""
    verdict = external.in_zone_window(F.col("lo"), F.col("hi") + 600_000_000, "Europe/Berlin", 79_200_000_000, 7_200_000_000)
    return b.events(spark, d).where("lo is not null").select("id", verdict.alias("verdict")).where("verdict is not null")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 3 THEN 'unparsed' WHEN 0 THEN 'ok' ELSE CASE WHEN day(ts) <= 12 AND day(ts) <> month(ts) THEN 'ambiguous' ELSE 'ok' END END AS status,
CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 AND day(ts) <= 12 THEN epoch_us(make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), floor(second(ts)))) ELSE epoch_us(date_trunc('second', ts)) END AS first FROM events""")
def overlay_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Events' clocks as overlays show them: year first, day first, month first without a blank, or not at all."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id")
    text = F.when(k % 4 == 0, F.date_format(ts, "'cam 'yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(ts, "dd-MM-yyyy HH:mm:ss")).when(k % 4 == 2, F.date_format(ts, "MM/dd/yyyyHH:mm:ss")).otherwise(F.lit("no clock"))
    rows = external.overlay_times(b.table(spark, d, "events").select(k.alias("id"), text.alias("text")))
    return rows.select("id", "overlay.status", F.get("overlay.candidates", F.lit(0)).alias("first"))


@query("""SELECT user_id AS log_id, CAST(event_id AS BIGINT) AS row_number, CASE WHEN user_id % 3 < 2 THEN 'node' || user_id % 3 END AS node, CASE WHEN event_id % 10 <> 0 THEN epoch_us(timezone('Europe/Berlin', date_trunc('minute', ts))) END AS lo,
CASE WHEN event_id % 10 <> 0 THEN epoch_us(timezone('Europe/Berlin', date_trunc('minute', ts))) + 60000000 END AS hi, CASE WHEN event_id % 10 = 0 THEN 'format' END AS reason FROM events""")
def external_entries(spark: SparkSession, d: str) -> DataFrame:
    """A log of each user's events, by Berlin's clock to the minute; one time in ten is no time, one location in three isn't mapped."""
    e, k = b.table(spark, d, "events"), F.col("event_id")
    time = F.when(k % 10 == 0, "unknown").otherwise(F.date_format(F.col("ts").cast("timestamp"), "d.M.yyyy HH:mm"))
    rows = e.select(F.col("user_id").alias("log_id"), k.alias("row_number"), time.alias("time"), F.col("event_type").alias("event"), F.concat(F.lit("place"), F.col("user_id") % 3).alias("location"))
    nodes = e.select((F.col("user_id") % 3).alias("k")).distinct().where("k < 2").select(F.concat(F.lit("place"), F.col("k")).alias("location"), F.concat(F.lit("node"), F.col("k")).alias("node"))
    return external.log_entries(rows, nodes, "%d.%m.%Y %H:%M", "Europe/Berlin").select("log_id", "row_number", "node", "lo", "hi", "reason")


@query("""SELECT img, count(*) AS candidates, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, list_sort(list("at") FILTER (NOT bad))[1:20]::BIGINT[] AS offsets, coalesce(list_sort(list("at") FILTER (bad))[1:20]::BIGINT[], []) AS rejected_offsets, CASE WHEN count(*) FILTER (NOT bad) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM b_frame GROUP BY img HAVING count(*) FILTER (NOT bad) > 0""", _FRAMES)
def recorder_identification(spark: SparkSession, d: str) -> DataFrame:
    """The framed streams' recorder, with the frames that were rejected."""
    found = identify.identification(images.chunked(framed(spark, d), CHUNK, framing.OVERLAP), CHUNK)
    levels = identify.matches(found).where("best and vendor = 'Dahua'").select("img", "confidence")
    return found.where("signature = 'dahua_dhav_frame'").select("img", "candidates", "accepted", "rejected", "offsets", "rejected_offsets").join(levels, "img")
