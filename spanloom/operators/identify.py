"""Identification of recorders by documented signatures: probes at fixed places, validated signatures, what was rejected and why.

Every candidate of a signature is checked where it lies; frames by their trailer, wherever that lies (framing.checked).
Counts are exact, lists of places hold the first ones. A vendor's confidence follows from the counts alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sliced, written
from ..sources.images import read_ranges
from .bytestream import EVIDENCE, signature_counts
from .framing import checked, headers

#: What stands where, and what may follow.
MASTER, MASTER_AT, MACHINE_AT, SECTOR = b"HIKVISION@HANGZHOU", 0x200, 34 * 512, 512
LOG_FOLLOWERS = (b"\x01\x00\x00\x00", b"\x14\x00\x00\x00")
STREAM_UNITS, STREAM_FLAGS, STREAM_LONGEST = (1, 5, 6, 7, 8, 9), (0x82, 0x02), 16 << 20
#: Microseconds of the years 2000 to 2100.
PLAUSIBLE_US = (946_684_800_000_000, 4_102_444_800_000_000)
PROBES = {"dahua_file_prefix": ("Dahua", 0, 5), "hik_master_0x200": ("Hikvision", MASTER_AT, len(MASTER)), "honeywell_machine_data": ("Honeywell", MACHINE_AT, SECTOR)}
PATTERNS = {"hik_master_any": MASTER, "hik_btree": b"HIKBTREE", "hik_rats_log": b"RATS", "honeywell_custom_header": b"\x80\x01\x00"}
VENDOR_OF = {n: v for n, (v, _, _) in PROBES.items()} | {"dahua_dhav_frame": "Dahua", "hik_master_any": "Hikvision", "hik_btree": "Hikvision", "hik_rats_log": "Hikvision", "honeywell_custom_header": "Honeywell"}
VENDORS = ("Dahua", "Hikvision", "Honeywell")


def stream_header(h: bytes) -> bool:
    """A header of 20 bytes, a start code and a unit: plausible length and time in either byte order."""
    if len(h) < 25 or h[0] not in STREAM_FLAGS or h[20:24] != b"\0\0\0\1" or h[24] & 0x80 or h[24] & 31 not in STREAM_UNITS:
        return False
    lengths = (*struct.unpack_from("<I", h, 8), *struct.unpack_from(">I", h, 8))
    times = (*struct.unpack_from("<Q", h, 12), *struct.unpack_from(">Q", h, 12))
    return any(1 <= n <= STREAM_LONGEST for n in lengths) and any(PLAUSIBLE_US[0] <= t <= PLAUSIBLE_US[1] for t in times)


def candidates(chunks: DataFrame) -> DataFrame:
    """(img, signature, at, good): every place of every pattern, and whether its surroundings are as documented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[tuple] = []
            for img, pos, data, before, after in zip(*(b.column(c).to_pylist() for c in ("img", "pos", "data", "before", "after"))):
                lead = before[-1:]
                whole = lead + data + after
                for name, pattern in PATTERNS.items():
                    k = whole.find(pattern, len(lead))
                    while 0 <= k < len(lead) + len(data):
                        good = True
                        if name == "hik_rats_log":
                            good = whole[k + 4 : k + 8] in LOG_FOLLOWERS
                        elif name == "honeywell_custom_header":
                            good = k > 0 and stream_header(whole[k - 1 : k + 24])
                        out.append((img, name, pos + k - len(lead), good))
                        k = whole.find(pattern, k + 1)
            kinds = [b.schema.field("img").type, pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["img", "signature", "at", "good"])

    kind = chunks.schema["img"].dataType.simpleString()
    local = chunks.select("img", "pos", "data", "before", "after").mapInArrow(run, f"img {kind}, signature string, at long, good boolean")
    sizes = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("size"))
    frames = checked(headers(chunks), sizes)
    good = F.col("reason").isNull() | (F.col("reason") == "extension overruns the frame")
    return local.unionByName(frames.select("img", F.lit("dahua_dhav_frame").alias("signature"), "at", good.alias("good")))


def probes(chunks: DataFrame) -> DataFrame:
    """(img, signature, at, checked, good): bytes at the documented places; not checked where an image ends before them."""
    sizes = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("size"))
    places = F.array(*(F.struct(F.lit(n).alias("signature"), F.lit(at).cast("long").alias("at"), F.lit(size).cast("long").alias("length")) for n, (_, at, size) in PROBES.items()))
    wanted = sizes.select("img", "size", F.inline(places))
    data = read_ranges(chunks, wanted.select("img", "at", "length"))
    rows = wanted.join(data.select("img", "at", "length", "data"), ["img", "at", "length"])
    model = F.decode("data", "ISO-8859-1").rlike(r"HN\d{4,}")
    good = F.when(F.col("signature") == "dahua_file_prefix", F.col("data") == F.lit(b"DAHUA")).when(F.col("signature") == "hik_master_0x200", F.col("data") == F.lit(MASTER)).otherwise(model)
    return rows.select("img", "signature", "at", (F.col("at") < F.col("size")).alias("checked"), (good & (F.col("at") < F.col("size"))).alias("good"))


def identification(chunks: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(img, vendor, signature, kind, candidates, accepted, rejected, offsets, rejected_offsets, reason) for each image and signature.

    offsets and rejected_offsets list the first EVIDENCE places. reason: why a signature doesn't match. Chunks as of
    spanloom.sources.images with an overlap of framing.OVERLAP or more; an image without bytes gives no rows.
    """
    found = written(candidates(chunks))
    tested = written(probes(chunks))
    counts = lambda good: signature_counts(found.where(F.col("good") == good).select("img", "signature", "at"), span, EVIDENCE)
    yes = counts(True).select("img", "signature", F.col("n").alias("accepted"), F.col("first").alias("offsets"))
    no = counts(False).select("img", "signature", F.col("n").alias("rejected"), F.col("first").alias("rejected_offsets"))
    names = F.explode(F.array(*(F.lit(n) for n in ("dahua_dhav_frame", *PATTERNS)))).alias("signature")
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    every = chunks.select("img").distinct().select("img", names).join(yes, ["img", "signature"], "left").join(no, ["img", "signature"], "left")
    rows = every.select("img", "signature", F.lit("signature").alias("kind"), F.coalesce("accepted", zero).alias("accepted"), F.coalesce("rejected", zero).alias("rejected"), F.coalesce("offsets", none).alias("offsets"), F.coalesce("rejected_offsets", none).alias("rejected_offsets"), F.lit(True).alias("checked"))
    fixed = tested.select("img", "signature", F.lit("probe").alias("kind"), F.col("good").cast("long").alias("accepted"), zero.alias("rejected"), F.when(F.col("good"), F.array("at")).otherwise(none).alias("offsets"), none.alias("rejected_offsets"), "checked")
    both = rows.unionByName(fixed)
    vendor = F.create_map(*(F.lit(x) for pair in VENDOR_OF.items() for x in pair))[F.col("signature")]
    reason = F.when(F.col("accepted") > 0, None).when(~F.col("checked"), "image ends before the documented offset").when(F.col("kind") == "probe", "bytes at the documented offset differ").when(F.col("rejected") > 0, "every occurrence failed the documented validation").otherwise("pattern not present")
    return both.select("img", vendor.alias("vendor"), "signature", "kind", (F.col("accepted") + F.col("rejected")).alias("candidates"), "accepted", "rejected", "offsets", "rejected_offsets", reason.alias("reason"))


def matches(found: DataFrame) -> DataFrame:
    """(img, vendor, confidence, best, ambiguous) of vendors of which anything matched, from rows of identification().

    best is the first vendor of the highest confidence; ambiguous says that a second one has the same.
    """
    n = lambda s: F.coalesce(F.sum(F.when(F.col("signature") == s, F.col("accepted"))), F.lit(0))
    counts = found.groupBy("img").agg(*(n(s).alias(s) for s in VENDOR_OF))
    has = lambda s: (F.col(s) > 0).cast("int")
    kinds = has("hik_master_any") + has("hik_btree") + has("hik_rats_log")
    level = {
        "Dahua": F.when(F.col("dahua_dhav_frame") >= 3, "medium").when(has("dahua_dhav_frame") + has("dahua_file_prefix") > 0, "low"),
        "Hikvision": F.when((F.col("hik_master_0x200") > 0) | (kinds >= 2), "medium").when(kinds > 0, "low"),
        "Honeywell": F.when((F.col("honeywell_custom_header") >= 3) & (F.col("honeywell_machine_data") > 0), "medium").when(has("honeywell_custom_header") + has("honeywell_machine_data") > 0, "low"),
    }
    rows = F.array_compact(F.array(*(F.when(level[v].isNotNull(), F.struct(F.lit(k).alias("rank"), F.lit(v).alias("vendor"), level[v].alias("confidence"))) for k, v in enumerate(VENDORS))))
    listed = counts.select("img", F.array_sort(F.transform(rows, lambda r: F.struct((r["confidence"] == "low").alias("low"), r["rank"], r["vendor"], r["confidence"]))).alias("m"))
    second = F.coalesce(F.get("m", F.lit(1))["confidence"] == F.get("m", F.lit(0))["confidence"], F.lit(False))
    return listed.select("img", F.posexplode("m").alias("k", "x"), second.alias("ambiguous")).select("img", "x.vendor", "x.confidence", (F.col("k") == 0).alias("best"), "ambiguous")
