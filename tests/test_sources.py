"""Byte ranges, partition tables, reading failing media and the event index's upsert."""

import random
import struct
import uuid
import zlib

import pyarrow as pa
import pytest

from spanloom.operators import partitions, placement
from spanloom.session import sliced
from spanloom.sources import images, resumable


def test_ranges_across_chunks(spark):
    rng = random.Random(1)
    data = {k: bytes(rng.randrange(256) for _ in range(rng.randint(0, 900))) for k in range(5)}
    wanted = [(k, rng.randrange(1000), rng.randrange(400)) for k in range(6) for _ in range(30)]
    for size in (16, 100, 1 << 20):
        chunks = images.chunked(spark.createDataFrame(list(data.items()), "img long, bytes binary"), size)
        rows = images.read_ranges(chunks, spark.createDataFrame(wanted, "img long, at long, length long"), size).collect()
        assert {(r.img, r.at, r.length) for r in rows} == {w for w in wanted if w[2]}
        assert all(bytes(r.data) == data.get(r.img, b"")[r.at : r.at + r.length] for r in rows)
    holes = spark.createDataFrame([(1, 0, b"abcd"), (1, 8, b"ijkl")], "img long, pos long, data binary")
    got = images.read_ranges(holes, spark.createDataFrame([(1, 2, 8), (1, 4, 2), (1, 9, 2)], "img long, at long, length long"), 4).collect()
    assert {r.at: bytes(r.data) for r in got} == {2: b"cd", 4: b"", 9: b"jk"}


# ---- GUID partition tables


def table(parts, sector=512, n=16, each=128, size=200, entries_at=2, alternate=None, my=1, spoil_header=False, spoil_entries=False, backup=True):
    entries = b"".join(kind.bytes_le + own.bytes_le + struct.pack("<QQQ", first, last, flags) + name.encode("utf-16-le").ljust(72, b"\0") + bytes(max(0, each - 128)) for kind, own, first, last, flags, name in parts)
    entries = entries.ljust(n * each, b"\0")
    alternate = size - 1 if alternate is None else alternate
    head = bytearray(b"EFI PART" + struct.pack("<IIIIQQQQ", 0x10000, 92, 0, 0, my, alternate, 34, size - 34) + uuid.UUID(int=7).bytes_le + struct.pack("<QIII", entries_at, n, each, zlib.crc32(entries)))
    head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)) ^ spoil_header)
    image = bytearray(size * sector)
    image[sector : sector + 92] = head
    image[entries_at * sector : entries_at * sector + len(entries)] = entries
    if spoil_entries:
        image[entries_at * sector + 40] ^= 1
    if backup and 0 < alternate < size:
        image[alternate * sector : alternate * sector + 8] = b"EFI PART"
    return bytes(image[: size * sector])


KIND, OWN = uuid.UUID("ebd0a0a2-b9e5-4433-87c0-68b6b72699c7"), uuid.UUID(int=99)


def test_partition_tables(spark):
    one, far, back = (KIND, OWN, 40, 99, 5, "Dätä"), (KIND, OWN, 50, 5000, 0, "far"), (KIND, OWN, 60, 50, 0, "back")
    made = {
        1: table([one]), 2: table([one, far, back], sector=4096, size=90), 3: table([one], spoil_header=True, my=3), 4: table([one], spoil_entries=True), 5: table([one], each=100), 6: table([one], n=2000),
        7: table([one], entries_at=198), 8: table([one], backup=False), 9: table([one], alternate=5000), 10: bytes(2000), 11: b"EFI PART", 12: table([one], n=40, each=256), 13: b"",
    }
    for chunk in (700, 1 << 20):
        chunks = images.chunked(spark.createDataFrame(list(made.items()), "img long, bytes binary"), chunk)
        heads, parts, bad = partitions.read_tables(chunks)
        got = {r.img: r for r in heads.collect()}
        assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 12} and got[2].sector == 4096 and got[1].checksum_ok and not got[3].checksum_ok and got[1].disk == str(uuid.UUID(int=7))
        rows = sorted((r.img, r.entry, r.type_guid, r.own_guid, r.s, r.e, r.attributes, r.name) for r in parts.collect())
        assert rows[0] == (1, 0, str(KIND), str(OWN), 40 * 512, 100 * 512, "0x0000000000000005", "Dätä")
        assert [(r[0], r[1], r[4], r[5]) for r in rows if r[0] == 2] == [(2, 0, 40 * 4096, 100 * 4096), (2, 1, 50 * 4096, 5001 * 4096), (2, 2, 60 * 4096, 51 * 4096)]
        assert [r[1] for r in rows if r[0] == 12] == [0]
        # the spoilt byte lies in the first entry's last sector number
        assert sorted(((r.img, r.kind, r.entry) for r in bad.collect()), key=str) == sorted([
            (2, "gpt_partition_beyond_image", 0), (2, "gpt_partition_beyond_image", 1), (2, "gpt_partition_negative_length", 2), (3, "gpt_header_crc_mismatch", None), (3, "gpt_my_lba_not_1", None),
            (4, "gpt_entries_crc_mismatch", None), (5, "gpt_entry_array_implausible", None), (6, "gpt_entry_array_implausible", None), (7, "gpt_entry_array_truncated", None), (8, "gpt_backup_header_missing", None),
        ], key=str)


def test_boot_sector_anomalies(spark):
    rows = [(1, 0, 128, 7, 10, 20), (1, 1, 0, 7, 25, 10), (1, 2, 5, 7, 60, 1000), (2, 0, 0, 238, 1, 99), (3, 0, 0, 238, 1, 99), (3, 1, 0, 7, 0, 1)]
    entries = spark.createDataFrame(rows, "img long, entry int, status long, kind long, first long, count long")
    sizes = spark.createDataFrame([(k, 100 * 512) for k in (1, 2, 3)], "img long, size long")
    got = partitions.mbr_anomalies(entries, sizes, spark.createDataFrame([(3,)], "img long")).collect()
    assert sorted((r.img, r.kind, r.entry) for r in got) == [(1, "mbr_invalid_status", 2), (1, "mbr_partition_beyond_image", 2), (1, "mbr_partitions_overlap", 1), (2, "protective_mbr_without_gpt", None)]


# ---- failing media


DATA = bytes(random.Random(4).randrange(256) for _ in range(5000))


class Failing(resumable.ImageSource):
    """Sectors 3, 4 and 7 can't be read; reads at multiples of 1024 fail once."""

    @classmethod
    def name(cls):
        return "failing"

    @staticmethod
    def opened(path):
        data = bytes(__import__("random").Random(4).randrange(256) for _ in range(5000))
        failed = set()

        def read(at, n):
            for bad, error in ((3, 5), (4, 5), (7, 6)):
                if at < (bad + 1) * 128 and bad * 128 < at + n:
                    raise OSError(error, {5: "Input/output error", 6: "No such device"}[error])
            if at % 1024 == 0 and at not in failed:
                failed.add(at)
                raise OSError(5, "once")
            return data[at : at + n]

        return len(data), read


def test_failing_medium(spark):
    spark.dataSource.register(Failing)
    df = spark.read.format("failing").options(path="x", chunk=1000, overlap=20, sector=128, chunks_a_task=2).load()
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == [0, 1000, 2000, 3000, 4000] and df.rdd.getNumPartitions() == 3
    whole = bytearray(DATA)
    for s, e in ((384, 640), (896, 1000)):  # sectors are counted from a chunk's begin
        whole[s:e] = bytes(e - s)
    assert b"".join(bytes(r.data) for r in rows)[:1000] == bytes(whole[:1000])
    assert [(x.s, x.e, x.error) for x in rows[0].bad] == [(384, 640, "Input/output error"), (896, 1000, "No such device")]
    assert bytes(rows[3].before) == DATA[2980:3000] and bytes(rows[3].after) == DATA[4000:4020] and bytes(rows[4].after) == b"" and bytes(rows[0].before) == b""
    again = spark.read.format("failing").options(path="x", chunk=1000, only="2000, 4000").load()
    assert sorted(r.pos for r in again.collect()) == [2000, 4000]


def test_files(spark, tmp_path):
    path = tmp_path / "disk.img"
    path.write_bytes(DATA)
    spark.dataSource.register(resumable.ImageSource)
    rows = sorted(spark.read.format("spanloom_image").options(path=str(path), chunk=512).load().collect(), key=lambda r: r.pos)
    assert b"".join(bytes(r.data) for r in rows) == DATA and {r.img for r in rows} == {"disk.img"} and not any(r.bad for r in rows)
    with pytest.raises(resumable.SourceChanged):
        resumable.read_through(lambda at, n: b"x", 0, 5, 1, 512)


# ---- index


def test_upsert(spark):
    kind = "run long, source string, row long, text string"
    stored = spark.createDataFrame([(7, 1, "object", 1, "old"), (9, 1, "object", 2, "gone"), (12, 1, None, 1, "null")], f"id long, {kind}")
    fresh = spark.createDataFrame([(1, "object", 1, "new"), (1, None, 1, "again"), (2, "motion", 5, "b"), (2, "motion", 4, "a")], kind)
    rows, counts = placement.upserted(stored, fresh, ["run", "source", "row"])
    assert sorted((r.id, r.text) for r in rows.collect()) == [(7, "new"), (12, "again"), (13, "a"), (14, "b")]
    assert {r.action: r.n for r in counts.collect()} == {"insert": 2, "update": 2, "remove": 1}
    rows, _ = placement.upserted(stored.limit(0), fresh, ["run", "source", "row"])
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4]


def test_slices_of_batches_are_small():
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "data": [bytes(10_000)] * 1000})
    parts = list(sliced([batch, batch.slice(0, 0)]))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(1000))
    assert max(p.num_rows for p in parts) <= 110 and parts[-1].num_rows == 0
    assert [p.num_rows for p in sliced([batch.slice(0, 3)], 5)] == [1, 1, 1]


def test_chunks_to_fetch_are_made_behind_the_shuffles(spark):
    rng = random.Random(2)
    sizes = {k: rng.choice([0, 1, 7, 64, 1000]) for k in range(20)}
    done = [(k, rng.choice([-8, 3, 8 * rng.randrange(140)]), rng.random() < 0.7) for k in range(22) for _ in range(60)]
    df = images.to_fetch(spark.createDataFrame(list(sizes.items()), "img long, size long"), spark.createDataFrame(done, "img long, pos long, ok boolean"), 8)
    have = {(k, p) for k, p, ok in done if ok}
    want = {(k, p, min(8, n - p)) for k, n in sizes.items() for p in range(0, n, 8) if (k, p) not in have}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Window") and plan.index("Generate") < plan.index("Join")  # top down
