"""GUID partition tables of chunked images: headers and entry arrays with their checksums, backup copies, anomalies as rows."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sliced, written
from ..sources.images import read_ranges

#: Fixed values of the format: sector sizes, the least header, the limits of an entry array.
SECTORS, HEADER, MAGIC = (512, 4096), 92, b"EFI PART"
ENTRY, MOST_ENTRIES = (128, 4096), 1024

HEADS = "sector long, found boolean, checksum_ok boolean, header_size long, my_sector long, alternate long, first_usable long, last_usable long, disk string, entries_at long, n_entries long, entry_size long, entries_checksum long"


def headers(chunks: DataFrame) -> DataFrame:
    """(img, size, HEADS): the header of each image that has one, of the first sector size where it stands."""
    sizes = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("size"))
    wanted = sizes.select("img", "size", F.explode(F.array(*(F.lit(s).cast("long") for s in SECTORS))).alias("at")).withColumn("length", F.col("at"))
    rows = read_ranges(chunks, wanted.where("at < size").select("img", "at", "length"))
    names = [x.split()[0] for x in HEADS.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5, pa.string(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            imgs, out = [], []
            for img, at, data in zip(*(b.column(c).to_pylist() for c in ("img", "at", "data"))):
                if len(data) >= HEADER and data[:8] == MAGIC:
                    size, checksum = struct.unpack_from("<II", data, 12)
                    own, other, first, last = struct.unpack_from("<QQQQ", data, 24)
                    entries, n, entry, sums = struct.unpack_from("<QIII", data, 72)
                    good = HEADER <= size <= len(data) and zlib.crc32(data[:16] + bytes(4) + data[20:size]) == checksum
                    imgs.append(img)
                    out.append((at, True, good, size, *(min(v, (1 << 62)) for v in (own, other, first, last)), str(uuid.UUID(bytes_le=data[56:72])), min(entries, 1 << 50), n, entry, sums))
            yield pa.RecordBatch.from_arrays([pa.array(imgs, b.schema.field("img").type), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["img", *names])

    img = chunks.schema["img"].dataType.simpleString()
    found = rows.mapInArrow(run, f"img {img}, {HEADS}")
    first = found.groupBy("img").agg(F.min_by(F.struct(*names), "sector").alias("h")).select("img", "h.*")
    return first.join(sizes, "img")


def entry_arrays(heads: DataFrame, chunks: DataFrame) -> DataFrame:
    """(img, at, data): the entry arrays of plausible headers, put together from all chunks they lie in."""
    return read_ranges(chunks, plausible(heads).select("img", (F.col("entries_at") * F.col("sector")).alias("at"), (F.col("n_entries") * F.col("entry_size")).alias("length")))


def plausible(heads: DataFrame, yes: bool = True) -> DataFrame:
    good = F.col("entry_size").between(*ENTRY) & (F.col("entry_size") % 8 == 0) & (F.col("n_entries") <= MOST_ENTRIES)
    return heads.where(good if yes else ~good)


PARTS = "entry int, type_guid string, own_guid string, first_sector long, last_sector long, attributes string, name string, s long, e long, array_length long, array_ok boolean"


def partitions(heads: DataFrame, chunks: DataFrame) -> DataFrame:
    """(img, size, sector, PARTS): the entries in use; entry is null in one row that tells of each array as a whole."""
    named = entry_arrays(heads, chunks).withColumnRenamed("at", "array_at")
    rows = named.join(plausible(heads).select("img", "size", "sector", "entries_checksum", "entry_size", "n_entries"), "img")
    names = ["size", "sector", *(x.split()[0] for x in PARTS.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    held = lambda v: min(v, 1 << 50)  # noqa: E731  a sector number whose byte offset fits a long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            imgs, out = [], []
            for img, data, size, sector, checksum, each, n in zip(*(b.column(c).to_pylist() for c in ("img", "data", "size", "sector", "entries_checksum", "entry_size", "n_entries"))):
                ok = zlib.crc32(data) == checksum if len(data) == n * each else None
                imgs.append(img)
                out.append((size, sector, *[None] * 9, len(data), ok))
                for k in range(len(data) // each):
                    x = data[k * each : (k + 1) * each]
                    if x[:16] != bytes(16):
                        first, last, attributes = struct.unpack_from("<QQQ", x, 32)
                        name = x[56:128].decode("utf-16-le", "replace").split("\0")[0]
                        imgs.append(img)
                        out.append((size, sector, k, str(uuid.UUID(bytes_le=x[:16])), str(uuid.UUID(bytes_le=x[16:32])), held(first), held(last), f"0x{attributes:016X}", name, held(first) * sector, (held(last) + 1) * sector, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(imgs, b.schema.field("img").type), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["img", *names])

    img = chunks.schema["img"].dataType.simpleString()
    return rows.mapInArrow(run, f"img {img}, size long, sector long, {PARTS}")


def anomalies(heads: DataFrame, parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(img, kind, entry, at): what is wrong with each table; entry is null where the whole table is meant."""
    none = F.lit(None).cast("int")
    of = lambda d, kind, test, at, entry=none: d.where(test).select("img", F.lit(kind).alias("kind"), entry.alias("entry"), at.alias("at"))
    array_at = F.col("entries_at") * F.col("sector")
    whole = plausible(heads).select("img", "entries_at", "n_entries", "entry_size").join(parts.where("entry is null"), "img")
    used, entry = parts.where("entry is not null"), F.col("entry")
    other = F.col("alternate") * F.col("sector")
    backup = heads.where((other > 0) & (other < F.col("size"))).select("img", other.alias("at"), F.lit(8).cast("long").alias("length"))
    copies = read_ranges(chunks, backup)
    rows = [
        of(heads, "gpt_header_crc_mismatch", ~F.col("checksum_ok"), F.col("sector")),
        of(heads, "gpt_my_lba_not_1", F.col("my_sector") != 1, F.col("sector")),
        of(plausible(heads, False), "gpt_entry_array_implausible", F.lit(True), F.col("sector")),
        of(whole, "gpt_entry_array_truncated", F.col("array_length") < F.col("n_entries") * F.col("entry_size"), array_at),
        of(whole, "gpt_entries_crc_mismatch", ~F.coalesce("array_ok", F.lit(True)), array_at),
        of(used, "gpt_partition_beyond_image", F.col("e") > F.col("size"), F.col("s"), entry),
        of(used, "gpt_partition_negative_length", F.col("last_sector") < F.col("first_sector"), F.col("s"), entry),
        of(copies, "gpt_backup_header_missing", F.col("data") != F.lit(MAGIC), F.col("at")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def mbr_anomalies(entries: DataFrame, sizes: DataFrame, guarded: DataFrame) -> DataFrame:
    """(img, kind, entry, at) of boot-sector entries (img, entry, status, kind, first, count) in images (img, size).

    guarded: (img) of those that have a GUID table. Entries of kind 0xEE stand for one; the others may neither end beyond
    the image nor begin before the one before them ends.
    """
    rows = entries.withColumns({"s": F.col("first") * 512, "e": (F.col("first") + F.col("count")) * 512})
    real = rows.where("kind <> 238")
    w = F.struct("s", "entry")
    before = real.select("img", F.struct("s", "entry", "e").alias("p"))
    # each boot sector has four entries at most, so the pairs of one are few
    last = real.join(before, "img").where(F.struct("p.s", "p.entry") < w).groupBy("img", "entry", "s").agg(F.max("p").alias("p"))
    bad = rows.where("status not in (0, 128)").select("img", F.lit("mbr_invalid_status").alias("kind"), "entry", F.col("s").alias("at"))
    beyond = real.join(sizes, "img").where("e > size").select("img", F.lit("mbr_partition_beyond_image").alias("kind"), "entry", F.col("s").alias("at"))
    overlap = last.where("s < p.e").select("img", F.lit("mbr_partitions_overlap").alias("kind"), "entry", F.col("s").alias("at"))
    alone = rows.where("kind = 238").select("img").distinct().join(guarded.select("img"), "img", "left_anti")
    lost = alone.select("img", F.lit("protective_mbr_without_gpt").alias("kind"), F.lit(None).cast("int").alias("entry"), F.lit(0).cast("long").alias("at"))
    return bad.unionByName(beyond).unionByName(overlap).unionByName(lost)


def read_tables(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, entries in use and anomalies of the GUID tables of all images."""
    heads = written(headers(chunks))
    parts = written(partitions(heads, chunks))
    return heads, parts.where("entry is not null").drop("array_length", "array_ok"), anomalies(heads, parts, chunks)
