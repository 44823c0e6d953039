"""Scans over chunked images: signatures, start codes, zero runs; headers, bit fields, partition tables and carved clips."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import sliced
from .along import spread
from .intervals import merge_spans

#: Offsets listed for a signature at most; its count is exact.
EVIDENCE = 20
BLOCK = 4096
#: Chunks whose evidence is put together in one step.
STEP = 1024


def hits(chunks: DataFrame, signatures: dict[str, bytes]) -> DataFrame:
    """(img, signature, at): every place where a signature begins, overlapping ones too; chunks as of spanloom.sources.images."""
    longest = max(map(len, signatures.values()), default=1)
    patterns = {n: re.compile(b"(?=" + re.escape(p) + b")", re.DOTALL) for n, p in signatures.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found: list[tuple] = []
            for img, pos, data, after in zip(*(b.column(c).to_pylist() for c in ("img", "pos", "data", "after"))):
                whole = data + after[: longest - 1]
                for name, p in patterns.items():
                    for m in p.finditer(whole):
                        if m.start() >= len(data):
                            break
                        found.append((img, name, pos + m.start()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], b.schema.field("img").type), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], ["img", "signature", "at"])

    kind = chunks.schema["img"].dataType.simpleString()
    return chunks.select("img", "pos", "data", "after").mapInArrow(run, f"img {kind}, signature string, at long")


def signature_counts(found: DataFrame, chunk: int, kept: int = EVIDENCE) -> DataFrame:
    """(img, signature, n, first): the exact number of hits and the first `kept` offsets, put together by chunk, then by STEP chunks."""
    least = lambda c: F.slice(F.array_sort(c), 1, kept)
    place = F.row_number().over(W.partitionBy("img", "signature", "part").orderBy("at"))  # a chunk's hits
    rows = found.withColumn("part", F.expr(f"at div {chunk}")).withColumn("place", place)
    by_chunk = rows.groupBy("img", "signature", "part").agg(F.count("*").alias("n"), least(F.collect_list(F.when(F.col("place") <= kept, F.col("at")))).alias("first"))
    by_step = by_chunk.groupBy("img", "signature", F.expr(f"part div {STEP}").alias("step")).agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("first"))).alias("first"))
    return by_step.groupBy("img", "signature").agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("first"))).alias("first"))


def identified(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """(img, vendor, n, confidence): of rules (vendor, signature, strong); 'high' from two strong signatures, 'medium' from one, 'low' from weak ones only."""
    met = counts.join(rules, "signature")
    g = met.groupBy("img", "vendor").agg(F.sum("n").alias("n"), F.count_if("strong").alias("strong"))
    return g.select("img", "vendor", "n", F.when(F.col("strong") >= 2, "high").when(F.col("strong") == 1, "medium").otherwise("low").alias("confidence"))


def start_codes(chunks: DataFrame) -> DataFrame:
    """(img, at, payload, long, head): NAL start codes 00 00 01; at: of the 4-byte form (long) where a zero goes before. head: two bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[tuple] = []
            for img, pos, data, before, after in zip(*(b.column(c).to_pylist() for c in ("img", "pos", "data", "before", "after"))):
                whole = before[-1:] + data + after[:4]
                skip = len(before[-1:])
                at = whole.find(b"\0\0\1", skip)
                while 0 <= at < skip + len(data):
                    head = whole[at + 3 : at + 5]
                    if head:  # none at the image's end
                        four = at > 0 and whole[at - 1] == 0
                        out.append((img, pos + at - skip - four, pos + at - skip + 3, four, head))
                    at = whole.find(b"\0\0\1", at + 1)
            types = [b.schema.field("img").type, pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["img", "at", "payload", "long", "head"])

    kind = chunks.schema["img"].dataType.simpleString()
    return chunks.select("img", "pos", "data", "before", "after").mapInArrow(run, f"img {kind}, at long, payload long, long boolean, head binary")


def byte(data: Column | str, at: int | Column) -> Column:
    """The unsigned byte at an offset; null beyond the end."""
    b = F.substring(data, F.lit(at + 1) if isinstance(at, int) else at + 1, F.lit(1))
    return F.when(F.length(b) > 0, F.conv(F.hex(b), 16, 10).cast("long"))


def little_endian(data: Column | str, at: int, size: int) -> Column:
    """The unsigned little-endian integer of `size` bytes, up to 7, at an offset."""
    return sum((F.shiftleft(byte(data, at + k), 8 * k) for k in range(1, size)), byte(data, at))


def nal_kind(head: Column | str) -> Column:
    """What a NAL header is: struct of codec and part ('vps', 'sps', 'pps') of a parameter set, else null."""
    b0, b1 = byte(head, 0), byte(head, 1)
    clear = b0.bitwiseAND(0x80) == 0
    h264 = F.when(clear & (b0.bitwiseAND(0x60) != 0), F.when(b0.bitwiseAND(31) == 7, "sps").when(b0.bitwiseAND(31) == 8, "pps"))
    layer = F.shiftleft(b0.bitwiseAND(1), 5) + F.shiftright(b1, 3)
    t = F.shiftright(b0, 1).bitwiseAND(63)
    h265 = F.when(clear & (b1.bitwiseAND(7) != 0) & (layer == 0), F.when(t == 32, "vps").when(t == 33, "sps").when(t == 34, "pps"))
    return F.when(h264.isNotNull(), F.struct(F.lit("h264").alias("codec"), h264.alias("part"))).when(h265.isNotNull(), F.struct(F.lit("h265").alias("codec"), h265.alias("part")))


def unescaped(data: Column | str) -> Column:
    """A NAL payload without its emulation-prevention bytes: 00 00 03 is 00 00."""
    return F.encode(F.regexp_replace(F.decode(data, "ISO-8859-1"), "\\x00\\x00\\x03", "\u0000\u0000"), "ISO-8859-1")


def exp_golomb(bits: Column, at: Column) -> Column:
    """(value, next): the unsigned Exp-Golomb number at a position (from 0) of a text of 0 and 1; null from 33 zeros on.

    For many fields of whole headers use spanloom.operators.bits, which reads bytes.
    """
    rest = F.substring(bits, at + 1, F.length(bits))
    zeros = F.instr(rest, "1") - 1
    good = (zeros >= 0) & (zeros <= 32)
    value = F.when(good, F.conv(F.substring(rest, zeros + 1, zeros + 1), 2, 10).cast("long") - 1)
    return F.when(good & (F.length(rest) >= 2 * zeros + 1), F.struct(value.alias("value"), (at + 2 * zeros + 1).alias("next")))


def zero_runs(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(img, s, e): maximal runs of whole blocks of zeros, a shorter last one included. Chunks begin at multiples of the block."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("data") - 1, F.lit(0)), F.lit(block))).alias("at")
    rows = chunks.where(F.length("data") > 0).select("img", "pos", "data", at)
    piece = F.substring("data", F.col("at") + 1, F.lit(block))
    empty = rows.select("img", (F.col("pos") + F.col("at")).alias("s"), F.length(piece).alias("n"), (piece == F.substring(F.lit(bytes(block)), F.lit(1), F.length(piece))).alias("zero")).where("zero")
    return merge_spans(empty.select("img", "s", (F.col("s") + F.col("n")).alias("e")), ["img"])


def mbr_entries(sectors: DataFrame) -> DataFrame:
    """(img, entry, kind, first, count): non-empty partitions of boot sectors (img, data) that end with 55 AA."""
    entries = F.array(*(F.struct(F.lit(k).alias("entry"), byte("data", 446 + 16 * k + 4).alias("kind"), little_endian("data", 446 + 16 * k + 8, 4).alias("first"), little_endian("data", 446 + 16 * k + 12, 4).alias("count")) for k in range(4)))
    signed = (byte("data", 510) == 0x55) & (byte("data", 511) == 0xAA)
    return sectors.where(signed).select("img", F.inline(entries)).where("kind <> 0 and count > 0")


def gpt_name(raw: Column | str) -> Column:
    """A partition's UTF-16 name, up to its first NUL."""
    return F.split_part(F.decode(raw, "UTF-16LE"), F.lit("\x00"), F.lit(1))


def guid(raw: Column | str) -> Column:
    """A mixed-endian GUID as text."""
    h = F.lower(F.hex(raw))
    order = [4, 3, 2, 1, 0, 6, 5, 0, 8, 7, 0, 9, 10, 0, 11, 12, 13, 14, 15, 16]
    return F.concat(*(F.substring(h, 2 * k - 1, 2) if k else F.lit("-") for k in order))


def carved(units: DataFrame, max_gap: int) -> DataFrame:
    """(img, kind, s, e, n_units): clips and orphans of units (img, at, end, part, vcl, random).

    Units of an image follow one another; a run ends at a gap of more than max_gap bytes. Within a run a clip begins
    at a parameter set after coded pictures, and one that holds no parameter set or no random-access picture is an
    orphan. Runs and clips are counted along the image in one window by its units; equal rows count once.
    """
    along = W.partitionBy("img").orderBy("at")
    rows = spread(units, "img").distinct().withColumns({"last": F.lag("end").over(along), "after_vcl": F.coalesce(F.lag("vcl").over(along), F.lit(False))})
    new = F.col("last").isNull() | (F.col("at") - F.col("last") > max_gap) | (F.col("part").isNotNull() & F.col("after_vcl"))
    runs = rows.withColumn("run", F.sum(new.cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    g = runs.groupBy("img", "run").agg(F.min("at").alias("s"), F.max("end").alias("e"), F.count("*").alias("n_units"), F.bool_or(F.col("part") == "sps").alias("sps"), F.bool_or(F.col("part") == "pps").alias("pps"), F.bool_or("random").alias("random"))
    whole = F.coalesce(F.col("sps") & F.col("pps") & F.col("random"), F.lit(False))
    return g.select("img", F.when(whole, "clip").otherwise("orphan").alias("kind"), "s", "e", "n_units")


def printable(data: pd.Series) -> pd.Series:
    """ASCII up to the first NUL; null where a byte is not printable."""
    heads = [bytes(x).split(b"\0", 1)[0] if x is not None else None for x in data]
    return pd.Series([h.decode("ascii") if h is not None and all(32 <= c < 127 for c in h) else None for h in heads])


def preview(data: Column | str, size: int = 16) -> Column:
    """(hex, text) of the first bytes, a point for each that isn't printable."""
    head = F.substring(data, 1, size)
    return F.struct(F.lower(F.hex(head)).alias("hex"), F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\\x20-\\x7e]", ".").alias("text"))
