"""Vendor structures as rows: fixed-stride lists that end at their first blank entry, and trees of pages with a backup.

Lists end where an entry is all zero. Each chunk gives the entries that begin in it; the least blank one of a list is an
aggregate, and the entries before it stay: two passes, no window, and a list may lie over any number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sliced, written
from ..sources.images import read_ranges
from .bytestream import byte, hits, little_endian

# ---- lists


def list_entries(chunks: DataFrame, lists: DataFrame, stride: int, most: int) -> DataFrame:
    """(img, list, n, at, entry): entries 0, 1, ... of lists (img, list, base) up to the first blank one, `most` or the image's end.

    Chunks need `stride` - 1 bytes or more of the next chunk. Columns of lists other than these are not looked at.
    """
    spans = lists.select("img", "list", F.col("base").alias("base"))
    data = F.concat("data", "after")
    met = chunks.where(F.length("data") > 0).select("img", "pos", F.length("data").alias("size"), data.alias("bytes")).join(spans, "img")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("base")) / stride)).cast("long")
    last = F.least(F.lit(most - 1), F.floor((F.col("pos") + F.col("size") - 1 - F.col("base")) / stride)).cast("long")
    rows = met.withColumns({"first": first, "last": last}).where("first <= last").withColumn("n", F.explode(F.sequence("first", "last")))
    at = F.col("base") + F.col("n") * stride
    entries = rows.select("img", "list", "n", at.alias("at"), F.substring("bytes", (at - F.col("pos") + 1).cast("int"), F.lit(stride)).alias("entry"))
    entries = written(entries.where(F.length("entry") == stride))
    # a short last entry is none; the list's end is the first blank or the first that isn't there
    blank = entries.where(F.col("entry") == F.lit(bytes(stride))).groupBy("img", "list").agg(F.min("n").alias("end"))
    return entries.join(blank, ["img", "list"], "left").where("end is null or n < end").drop("end")


#: Fixed values of the first vendor's format.
BASE, PAGE, VIDEO = 0x5000, 0x1000, 0x80000000
BLOCKS, CHANNELS, STRIDE, STREAM_HEADER = 0x40000, 0x400000, 16, 20
FRAME_MARK, FRAME_FLAGS = b"\x80\x01\x00", (0x82, 0x02)
ENTRIES = 4096
#: Plausible seconds since 1970: the years 2000 to 2100.
PLAUSIBLE = (946_684_800, 4_102_444_800)


def block_list(chunks: DataFrame, plausible: tuple[int, int] = PLAUSIBLE, base: int = BASE) -> DataFrame:
    """(img, n, start, block, group, valid): the video block list; an entry with reserved bytes or an odd time isn't valid."""
    lists = chunks.select("img").distinct().select("img", F.lit(0).alias("list"), F.lit(base + BLOCKS).cast("long").alias("base"))
    rows = list_entries(chunks, lists, STRIDE, ENTRIES)
    start = little_endian("entry", 4, 4)
    return rows.select("img", "n", start.alias("start"), byte("entry", 12).alias("block"), byte("entry", 13).alias("grp"), ((little_endian("entry", 0, 4) == 0) & start.between(*plausible)).alias("valid"))


def channel_index(chunks: DataFrame, video_inside: bool | Column, plausible: tuple[int, int] = PLAUSIBLE, base: int = BASE) -> DataFrame:
    """(img, n, channel, stream, s, e, start, reason): the channel index; reason tells why an entry isn't usable.

    Of several reasons the first counts: stream type, length or time; before the video data (where that lies inside the
    image); beyond the image; no stream header where it points to.
    """
    images = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("size"))
    rows = list_entries(chunks, images.select("img", F.lit(0).alias("list"), F.lit(base + CHANNELS).cast("long").alias("base")), STRIDE, ENTRIES)
    kind, length, start, place = byte("entry", 1), little_endian("entry", 2, 2), little_endian("entry", 4, 4), little_endian("entry", 8, 4)
    rows = rows.select("img", "n", byte("entry", 0).alias("channel"), kind.alias("stream"), (place * PAGE + base).alias("s"), length.alias("length"), start.alias("start"))
    marks = hits(chunks, {f"{f:02x}": bytes([f]) + FRAME_MARK for f in FRAME_FLAGS}).select("img", F.col("at").alias("s"), F.lit(True).alias("marked")).distinct()
    inside = F.lit(video_inside) if isinstance(video_inside, bool) else video_inside
    reason = (
        F.when(~F.col("stream").isin(0x00, 0x20) | (F.col("length") == 0) | ~F.col("start").between(*plausible), "bad_stream_type")
        .when(inside & (F.col("s") - base < VIDEO), "before_video")
        .when(F.col("s") + STREAM_HEADER > F.col("size"), "beyond_image")
        .when(F.col("marked").isNull(), "no_header_at_start")
    )
    met = rows.join(images, "img").join(marks, ["img", "s"], "left")
    return met.select("img", "n", "channel", "stream", "s", (F.col("s") + F.col("length") * PAGE).alias("e"), "start", reason.alias("reason"))


# ---- trees of pages


#: Fixed values of the second vendor's format.
TREE, TREE_HEADER, TREE_PAGE, SLOT = b"HIKBTREE", 0x60, 4096, 48
STARTS = tuple(range(0, 0x48, 8))
LARGEST, MOST_PAGES = 16 << 20, 4096


def trees(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(img, tree, base, size, lo, hi, footer, list, page1, fault): headers of trees at places (img, tree, base, size, lo, hi).

    lo and hi bound the blocks that entries may point to. fault: why a tree can't be read.
    """
    asked = places.select("img", "tree", "base", "size", "lo", "hi")
    images = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("image"))
    heads = read_ranges(chunks, asked.select("img", F.col("base").alias("at"), F.lit(TREE_HEADER).cast("long").alias("length")))
    rows = asked.join(images, "img").join(heads.select("img", F.col("at").alias("base"), "data"), ["img", "base"], "left")
    field = lambda at: little_endian("data", at, 7)  # noqa: E731  offsets of 56 bits
    rows = rows.withColumns({"footer": field(0x30), "list": field(0x40), "page1": field(0x48)})
    end = F.col("base") + F.col("size")
    outside = lambda c: (F.col(c) < F.col("base")) | (F.col(c) >= end)
    fault = (
        F.when((F.col("size") <= 0) | (F.col("size") > LARGEST) | (F.col("base") + TREE_HEADER > F.col("image")), "unusable")
        .when(F.substring("data", 1, 8) != F.lit(TREE), "signature")
        .when(outside("footer"), "footer outside").when(outside("list"), "page list outside").when(outside("page1"), "page 1 outside")
    )
    return rows.select("img", "tree", "base", "size", "lo", "hi", "footer", "list", "page1", fault.alias("fault"))


def page_list(chunks: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(img, tree, k, at, verdict) of each listed page, and (img, tree, fault) of the lists.

    Offsets stand 8 or 16 bytes apart: the first distance at which all pages lie within the tree, else 8. verdict is null
    for pages that are read; 'repeats' for one that is the header, the list, the footer or an earlier page; or 'outside'.
    """
    good = heads.where("fault is null")
    counts = read_ranges(chunks, good.select("img", F.col("list").alias("at"), F.lit(16).cast("long").alias("length")))
    rows = good.join(counts.select("img", F.col("at").alias("list"), F.coalesce(little_endian("data", 0, 4), F.lit(0)).alias("total")), ["img", "list"], "left")
    absurd = (F.col("total") > MOST_PAGES) | (F.col("total") > F.floor(F.col("size") / TREE_PAGE) + 1)
    rows = written(rows.withColumn("absurd", absurd))
    sane = rows.where("not absurd and total > 0")
    lists = read_ranges(chunks, sane.select("img", (F.col("list") + 8).alias("at"), (F.col("total") * 16).alias("length")))
    held = sane.join(lists.select("img", (F.col("at") - 8).alias("list"), "data"), ["img", "list"])
    end = F.col("base") + F.col("size")

    def offsets(step: int) -> Column:
        n = F.least(F.col("total"), F.floor(F.length("data") / step)).cast("int")
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _offset(F.col("data"), k * step))
        return F.when(n > 0, at).otherwise(F.array().cast("array<bigint>"))

    held = held.withColumns({"near": offsets(8), "far": offsets(16)})
    fits = lambda c: (F.size(c) == F.col("total")) & F.forall(c, lambda o: (o >= F.col("base")) & (o + TREE_PAGE <= end))
    held = written(held.withColumn("offsets", F.when(fits("near"), F.col("near")).when(fits("far"), F.col("far")).otherwise(F.col("near"))))
    each = held.select("img", "tree", "base", "size", "list", "footer", F.posexplode("offsets").alias("k", "at"))
    inside = (F.col("at") >= F.col("base")) & (F.col("at") + TREE_PAGE <= F.col("base") + F.col("size"))
    own = (F.col("at") == F.col("base")) | (F.col("at") == F.col("list")) | (F.col("at") == F.col("footer"))
    first = each.where(inside & ~own).groupBy("img", "tree", "at").agg(F.min("k").alias("first"))
    met = each.join(first, ["img", "tree", "at"], "left")
    pages = met.select("img", "tree", "k", "at", F.when(own | (F.col("k") > F.col("first")), "repeats").when(~inside, "outside").alias("verdict"))
    last = read_ranges(chunks, sane.select("img", F.col("footer").alias("at"), F.lit(8).cast("long").alias("length")))
    ends = held.join(last.select("img", F.col("at").alias("footer"), _offset(F.col("data"), F.lit(0)).alias("stated")), ["img", "footer"])
    say = lambda d, test, name: d.where(test).select("img", "tree", F.lit(name).alias("fault"))
    faults = say(rows, F.col("absurd"), "absurd page count")
    for d, test, name in (
        (held, (F.size("offsets") > 0) & (F.get("offsets", F.lit(0)) != F.col("page1")), "page 1 differs from the header's"),
        (held, F.size("offsets") < F.col("total"), "list shorter than its count"),
        (ends, (F.size("offsets") > 0) & F.col("stated").isNotNull() & (F.element_at("offsets", -1) != F.col("stated")), "footer differs from the last page"),
    ):
        faults = faults.unionByName(say(d, test, name))
    return pages, heads.where("fault is not null").select("img", "tree", "fault").unionByName(faults)


def _offset(data: Column, at: Column) -> Column:
    """A little-endian number of 8 bytes whose last is taken as 0 if it is over 63, as a place far beyond any image."""
    part = lambda k: F.conv(F.hex(F.substring(data, at + k + 1, F.lit(1))), 16, 10).cast("long")
    top = F.when(part(7) > 63, F.lit(1 << 62)).otherwise(F.shiftleft(part(7), 56))
    return F.when(F.length(data) >= at + 8, top + sum((F.shiftleft(part(k), 8 * k) for k in range(1, 7)), part(0)))


def page_votes(chunks: DataFrame, pages: DataFrame, heads: DataFrame) -> DataFrame:
    """(img, tree, k, page, start, at, exists, channel, begin, end, block, kind): every slot of every page at every start that may
    be right; kind is 'ok' or 'bad' (blank ones are left out)."""
    good = pages.where("verdict is null")
    data = read_ranges(chunks, good.select("img", "at", F.lit(TREE_PAGE).cast("long").alias("length")))
    rows = good.join(data.select("img", "at", "data"), ["img", "at"]).join(heads.select("img", "tree", "lo", "hi"), ["img", "tree"])
    names = ["k", "page", "start", "at", "exists", "channel", "begin", "end", "block", "kind"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, out = [], []
            for img, tree, k, page, raw, lo, hi in zip(*(b.column(c).to_pylist() for c in ("img", "tree", "k", "at", "data", "lo", "hi"))):
                for start in STARTS:
                    n = (len(raw) - start) // SLOT
                    if n <= 0:
                        continue
                    grid = np.frombuffer(raw, np.uint8, n * SLOT, start).reshape(n, SLOT)
                    used = ~((grid == 0).all(1) | (grid == 255).all(1))
                    same = (grid[:, 8:16] == grid[:, 8:9]).all(1) & np.isin(grid[:, 8], (0, 255))
                    block = grid[:, 0x20:0x28].copy().view("<u8")[:, 0]
                    begin, end = (grid[:, c : c + 4].copy().view("<u4")[:, 0] for c in (0x18, 0x1C))
                    ok = same & (block >= lo) & (block < hi)
                    for s in np.flatnonzero(used).tolist():
                        ids.append((img, tree))
                        out.append((k, page, start, page + start + s * SLOT, bool(grid[s, 8] == 0), int(grid[s, 0x11]), int(begin[s]), int(end[s]), min(int(block[s]), 1 << 62), "ok" if ok[s] else "bad"))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], b.schema.field("img").type), pa.array([x[1] for x in ids], pa.string()), *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], ["img", "tree", *names])

    img = chunks.schema["img"].dataType.simpleString()
    return rows.select("img", "tree", "k", "at", "data", "lo", "hi").mapInArrow(run, f"img {img}, tree string, k int, page long, start int, at long, exists boolean, channel int, begin long, end long, block long, kind string")


def tree_entries(chunks: DataFrame, pages: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(img, tree, place, at, exists, channel, begin, end, block) of each tree in the pages' order, and (img, tree, start, n_ok, n_bad).

    Where entries begin within a page is voted on: the start with most plausible slots over all pages of a tree, the least
    of equal ones. Bad slots are counted at that start.
    """
    votes = written(page_votes(chunks, pages, heads))
    counts = votes.groupBy("img", "tree", "start").agg(F.count_if(F.col("kind") == "ok").alias("n_ok"), F.count_if(F.col("kind") == "bad").alias("n_bad")).where("n_ok > 0")
    best = counts.groupBy("img", "tree").agg(F.max(F.struct("n_ok", (-F.col("start")).alias("before"), "n_bad")).alias("b")).select("img", "tree", (-F.col("b.before")).alias("start"), "b.n_ok", "b.n_bad")
    rows = votes.where("kind = 'ok'").join(best.select("img", "tree", "start"), ["img", "tree", "start"])
    place = (F.col("k").cast("long") * TREE_PAGE + F.col("at") - F.col("page")).alias("place")
    return rows.select("img", "tree", place, "at", "exists", "channel", "begin", "end", "block"), best


def tree_differences(entries: DataFrame, tree: str, backup: str) -> DataFrame:
    """(img, block, channel, exists, begin, end, n): entries that one of the two trees holds more often than the other."""
    key = ["img", "block", "channel", "exists", "begin", "end"]
    side = F.when(F.col("tree") == tree, 1).when(F.col("tree") == backup, -1)
    return entries.withColumn("side", side).groupBy(*key).agg(F.sum("side").alias("n")).where("n <> 0")
