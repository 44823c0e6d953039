"""Framed streams (DHAV): frames found by their magic, followed from one to the next, and clips of each channel.

A frame has a header, an extension, a payload and a trailer that repeats its length. Headers and trailers are found
wherever they lie and joined by position and length, so no frame is read as a whole. The frames that count are those that
a walk from the image's first magic meets: behind a valid frame it goes on at its end, behind anything else at the next
byte. That is a functional graph, and what the walk meets is found by pointer doubling (pointers.reachable) in log rounds.

Chains of adjoining frames are runs. Within a run each channel's video frames make clips, which begin at key frames and
end where frame numbers jump or codec or size change; other frames are orphans. A key frame that states no codec or size
has those of the key frame before it in its clip.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sliced, written
from .along import SPAN, coming, following, preceding
from .pointers import reachable

#: Fixed values of the format: frame types, extension fields and their sizes, codecs, the longest frame.
AUDIO, OTHER, PICTURE, KEY = 0xF0, 0xF1, 0xFC, 0xFD
FIELD_SIZES = {0x80: 4, 0x81: 4, 0x82: 8, 0x83: 4, 0x84: 4, 0x85: 4, 0x88: 8, 0x8B: 4, 0x8C: 8, 0x91: 8, 0x92: 8, 0x93: 8, 0x94: 4, 0x95: 8, 0x96: 4, 0x9A: 8, 0x9B: 8, 0xA0: 4, 0xB2: 4, 0xB3: 8, 0xB4: 4}
CODECS = {0x1: "mpeg4", 0x2: "h264", 0x3: "mjpeg", 0x4: "h264", 0x8: "h264", 0xC: "h265"}
LONGEST = 16 << 20
HEADER, TRAILER = 24, 8
#: Bytes behind a chunk that a header with its extension and the payload's first bytes may need.
OVERLAP = HEADER + 255 + 4


def extension(data: bytes) -> tuple[dict[str, int], int]:
    """Fields of a header's extension, and how much of it they take: all of it from an unknown or cut field on."""
    out: dict[str, int] = {}
    at = 0
    while at < len(data):
        size = FIELD_SIZES.get(data[at])
        if size is None or at + size > len(data):
            return out, len(data)
        if data[at] == 0x80:
            out |= {"width": 8 * data[at + 2], "height": 8 * data[at + 3]}
        elif data[at] == 0x81:
            out |= {"codec": data[at + 2], "rate": data[at + 3]}
        elif data[at] == 0x82:
            out |= dict(zip(("width", "height"), struct.unpack_from("<HH", data, at + 4)))
        at += size
    return out, at


HEADERS = "at long, kind string, type int, channel int, number long, length long, date long, taken int, stated int, codec string, width int, height int, annexb boolean"


def headers(chunks: DataFrame) -> DataFrame:
    """(img, HEADERS): kind 'head' for each DHAV magic, 'cut' if its header is cut off, 'tail' (at, length) for each trailer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEADERS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        for b in sliced(batches):
            imgs, rows = [], []
            for img, pos, data, after in zip(*(b.column(c).to_pylist() for c in ("img", "pos", "data", "after"))):
                whole = data + after
                for magic in (b"DHAV", b"dhav"):
                    k = whole.find(magic)
                    while 0 <= k < len(data):
                        row = dict.fromkeys(names) | {"at": pos + k, "kind": "head"}
                        head = whole[k : k + HEADER]
                        if magic == b"dhav":
                            if k + TRAILER <= len(whole):
                                row |= {"kind": "tail", "length": struct.unpack_from("<I", whole, k + 4)[0]}
                            else:
                                row["kind"] = "cut tail"
                        elif len(head) < HEADER:
                            row["kind"] = "cut"
                        else:
                            number, length, date = struct.unpack_from("<III", head, 8)
                            found, taken = extension(whole[k + HEADER : k + HEADER + head[22]])
                            start = whole[k + HEADER + taken : k + HEADER + taken + 4]
                            row |= {"type": head[4], "channel": head[6], "number": number, "length": length, "date": date, "taken": taken, "stated": head[22]}
                            row |= {"codec": CODECS.get(found["codec"]) if "codec" in found else None, "width": found.get("width"), "height": found.get("height")}
                            row["annexb"] = start[:3] == b"\0\0\1" or start == b"\0\0\0\1"
                        imgs.append(img)
                        rows.append(row)
                        k = whole.find(magic, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(imgs, b.schema.field("img").type), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds))], ["img", *names])

    kind = chunks.schema["img"].dataType.simpleString()
    return chunks.select("img", "pos", "data", "after").mapInArrow(run, f"img {kind}, {HEADERS}")


def checked(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Heads with `reason`: why one isn't a frame, null if it is; sizes: (img, size)."""
    tails = found.where("kind = 'tail'").select(F.col("img").alias("_img"), F.col("at").alias("_at"), F.col("length").alias("_length"))
    heads = found.where("kind in ('head', 'cut')").join(sizes.select("img", "size"), "img")
    ends = heads.join(tails, (F.col("img") == F.col("_img")) & (F.col("at") + F.col("length") - TRAILER == F.col("_at")) & (F.col("length") - TRAILER == F.col("_length")), "left")
    overrun = (F.col("type") != OTHER) & (F.col("at") + HEADER + F.col("taken") > F.col("at") + F.col("length") - TRAILER)
    reason = (
        F.when(F.col("kind") == "cut", "truncated header")
        .when(~F.col("type").isin(AUDIO, OTHER, PICTURE, KEY), F.concat(F.lit("unknown frame type 0x"), F.lower(F.lpad(F.hex("type"), 2, "0"))))
        .when((F.col("length") < HEADER) | (F.col("length") > LONGEST) | (F.col("at") + F.col("length") > F.col("size")), F.concat(F.lit("frame length "), F.col("length").cast("string"), F.lit(" out of range or beyond the image")))
        .when(F.col("_at").isNull(), "trailer missing or length mismatch")
        .when(overrun, "extension overruns the frame")
    )
    return ends.withColumn("reason", reason).drop("_img", "_at", "_length")


def walked(heads: DataFrame, span: int = SPAN) -> tuple[DataFrame, int]:
    """The heads that the walk meets, with `met` (the head at a frame's very end is met by a chain), and the rounds taken.

    Heads have one row a place. A frame's successor is the first head at or behind its end, another head's the next head.
    """
    key = F.struct("img", "at")
    valid = F.col("reason").isNull()
    line = heads.select("img", "at", valid.alias("valid"), (F.col("at") + F.col("length")).alias("end"), (2 * F.col("at")).alias("order"), F.col("at").alias("head"))
    asks = line.where("valid").select("img", "at", "valid", "end", (2 * F.col("end") - 1).alias("order"), F.lit(None).cast("long").alias("head"))
    ends = coming(asks.unionByName(line), "img", "order", "head", 2 * span).where("head is null").select("img", "at", F.col("coming_head").alias("next"))
    # asks of several frames may share a place: each is still a row of its own
    others = following(line, "img", "at", "head", span).where("not valid").select("img", "at", F.col("next_head").alias("next"))
    links = ends.unionByName(others).select(key.alias("id"), F.when(F.col("next").isNotNull(), F.struct("img", F.col("next").alias("at"))).alias("next"))
    roots = heads.groupBy("img").agg(F.min("at").alias("at")).select(key.alias("id"))
    met, rounds = reachable(links, roots)
    return heads.join(met.select("id.img", "id.at"), ["img", "at"]), rounds


def frames(chunks: DataFrame, span: int = SPAN) -> tuple[DataFrame, int]:
    """The heads that a walk over each image meets, with reason, run (the place of its run's first frame) and payload [p0, p1).

    Chunks as of spanloom.sources.images, with an overlap of OVERLAP or more; and the rounds that the walk took.
    """
    sizes = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("size"))
    heads = written(checked(written(headers(chunks)), sizes))
    met, rounds = walked(heads, span)
    ends = met.where("reason is null").select("img", (F.col("at") + F.col("length")).alias("at"), F.lit(True).alias("after"))
    rows = written(met.join(ends, ["img", "at"], "left"))
    first = F.when(F.col("reason").isNull() & F.col("after").isNull(), F.col("at"))
    runs = preceding(rows.withColumn("first", first), "img", "at", "first", span).withColumn("run", F.when(F.col("reason").isNull(), F.coalesce("first", "last_first")))
    plain = F.col("type") == OTHER
    p0 = F.when(plain, F.col("at")).otherwise(F.col("at") + HEADER + F.col("taken"))
    p1 = F.when(plain, F.col("at")).otherwise(F.col("at") + F.col("length") - TRAILER)
    return runs.withColumns({"p0": p0, "p1": p1}).drop("first", "last_first"), rounds


def rejections(met: DataFrame) -> DataFrame:
    """(img, reason, n): heads met that are no frames; one right behind a frame is met twice, at the chain's end and by the search."""
    bad = met.where("reason is not null")
    again = F.when(F.col("after") & (F.col("at") + HEADER <= F.col("size")), 2).otherwise(1)
    return bad.groupBy("img", "reason").agg(F.sum(again).alias("n"))


def channel_clips(met: DataFrame, tolerance: int = 3, least: int = 1, span: int = SPAN) -> DataFrame:
    """(img, channel, kind, s, e, frames, keys, codec, width, height, first_date, last_date, reason) of frames (as of frames()).

    kind is 'clip' or 'orphan'; a clip of fewer than `least` frames is an orphan. s and e are the first payload's begin
    and the last one's end.
    """
    video = met.where(f"reason is null and type in ({PICTURE}, {KEY})").withColumn("lane", F.struct("img", "channel"))
    step = lambda d, v: preceding(d, "lane", "at", v, span)
    seen = video.withColumn("own", F.struct("run", "number"))
    seen = step(seen, "own")
    jump = F.pmod(F.col("number") - F.col("last_own.number"), F.lit(1 << 32))
    cut = F.col("last_own").isNull() | (F.col("last_own.run") != F.col("run")) | (jump > tolerance + 1)
    seen = written(seen.withColumn("stretch", F.when(cut, F.col("at"))).withColumn("why", F.when(cut, F.when(F.col("last_own.run") == F.col("run"), "frame_number discontinuity").otherwise("end of contiguous DHAV frame run"))))
    seen = step(seen, "stretch").withColumn("stretch_of", F.coalesce("stretch", "last_stretch"))
    key = F.col("type") == KEY
    stated = F.when(key & F.col("codec").isNotNull(), F.struct("stretch_of", "codec"))
    sized = F.when(key & (F.col("width") > 0), F.struct("stretch_of", "width", "height"))
    seen = seen.withColumns({"key_at": F.when(key, F.struct("stretch_of", "at")), "stated_codec": stated, "stated_size": sized})
    for c in ("key_at", "stated_codec", "stated_size"):
        seen = step(seen, c)
    # whether the frame before stood in an open clip, and whether that is the frame's own stretch
    same = lambda c: F.col(f"last_{c}.stretch_of") == F.col("last_stretch")
    before = F.coalesce(same("key_at"), F.lit(False)) & (F.col("last_own.run") == F.col("run"))
    on = before & F.col("stretch").isNull()
    codec_before = F.when(F.coalesce(same("stated_codec"), F.lit(False)), F.col("last_stated_codec.codec")).otherwise("unknown")
    size_before = F.when(F.coalesce(same("stated_size"), F.lit(False)), F.struct(F.col("last_stated_size.width").alias("width"), F.col("last_stated_size.height").alias("height")))
    size_now = F.struct("width", "height")
    changed = key & before & (F.coalesce(F.col("codec") != codec_before, F.lit(False)) | ((F.col("width") > 0) & ~size_now.eqNullSafe(size_before)))
    changed = F.coalesce(changed, F.lit(False))
    opens = F.coalesce(key & (~on | changed), F.lit(False))
    active = on | key
    seen = written(seen.withColumns({"opens": F.when(opens, F.col("at")), "active": active, "ended": F.when(changed, "codec/resolution change").when(F.col("stretch").isNotNull(), F.col("why"))}))
    # what ends a clip stands at the first frame behind it
    seen = coming(step(seen, "opens"), "lane", "at", "ended", span).withColumn("clip", F.coalesce("opens", "last_opens"))
    order = F.struct("at")
    clips = seen.where("active").groupBy("img", "channel", "clip").agg(
        F.min("p0").alias("s"), F.max("p1").alias("e"), F.count("*").alias("frames"), F.count_if(key).alias("keys"), F.coalesce(F.min_by("codec", order), F.lit("unknown")).alias("codec"), F.min_by("width", order).alias("width"),
        F.min_by("height", order).alias("height"), F.min_by("date", order).alias("first_date"), F.max_by("date", order).alias("last_date"), F.coalesce(F.max_by("coming_ended", order), F.lit("end of contiguous DHAV frame run")).alias("reason"),
    )
    short = F.col("frames") < least
    clips = clips.select("img", "channel", F.when(short, "orphan").otherwise("clip").alias("kind"), "s", "e", "frames", "keys", "codec", "width", "height", "first_date", "last_date", F.when(short, "clip too short").otherwise(F.col("reason")).alias("reason"))
    # orphans go on across runs, over gaps of 64 bytes and the frame's own length, until a clip opens
    lost = seen.where("not active or opens is not null").withColumn("stray", F.when(~F.col("active"), F.col("p1")).otherwise(F.lit(-1)))
    lost = preceding(lost, "lane", "at", "stray", span).where("not active")
    new = F.col("last_stray").isNull() | (F.col("last_stray") < 0) | (F.col("at") - F.col("last_stray") > 64 + F.col("length"))
    lost = preceding(lost.withColumn("begins", F.when(new, F.col("at"))), "lane", "at", "begins", span).withColumn("orphan", F.coalesce("begins", "last_begins"))
    orphans = lost.groupBy("img", "channel", "orphan").agg(F.min("p0").alias("s"), F.max("p1").alias("e"), F.count("*").alias("frames"))
    none = {c: F.lit(None).cast(t) for c, t in (("codec", "string"), ("width", "int"), ("height", "int"), ("first_date", "long"), ("last_date", "long"))}
    orphans = orphans.select("img", "channel", F.lit("orphan").alias("kind"), "s", "e", "frames", F.lit(0).cast("long").alias("keys"), *(v.alias(k) for k, v in none.items()), F.lit("non-key video frames without a preceding key frame").alias("reason"))
    return clips.unionByName(orphans)


def frame_date(date: Column) -> Column:
    """The wall clock of a packed date, as text; it may be no real date."""
    part = lambda at, width, n: F.lpad(F.shiftright(date, at).bitwiseAND((1 << width) - 1).cast("string"), n, "0")
    year = (F.shiftright(date, 26).bitwiseAND(63) + 2000).cast("string")
    return F.concat(F.concat_ws("-", year, part(22, 4, 2), part(17, 5, 2)), F.lit(" "), F.concat_ws(":", part(12, 5, 2), part(6, 6, 2), part(0, 6, 2)))
