"""Lists up to a blank entry and trees of pages, against plain versions and across chunks."""

import random
import struct

import pytest

from spanloom.operators import listing
from spanloom.sources import images

T = 1_700_000_000


def plain_list(data, base, stride, most):
    out = []
    for n in range(most):
        e = data[base + n * stride : base + (n + 1) * stride]
        if len(e) < stride or e == bytes(stride):
            break
        out.append((n, e))
    return out


@pytest.mark.parametrize("chunk", [20, 333, 1 << 20])
def test_lists_end_at_the_first_blank(spark, chunk):
    rng = random.Random(chunk)
    data = {k: b"".join(bytes(16) if rng.random() < 0.1 else bytes(rng.randrange(3) for _ in range(16)) for _ in range(60)) + b"tail" for k in range(4)}
    lists = [(k, j, rng.choice([0, 7, 100, 5000])) for k in range(5) for j in range(3)]
    chunks = images.chunked(spark.createDataFrame(list(data.items()), "img long, bytes binary"), chunk)
    got = {}
    for r in listing.list_entries(chunks, spark.createDataFrame(lists, "img long, list int, base long"), 16, 40).collect():
        got.setdefault((r.img, r["list"]), []).append((r.n, bytes(r.entry)))
    assert {k: sorted(v) for k, v in got.items()} == {(k, j): v for k, j, b in lists if (v := plain_list(data.get(k, b""), b, 16, 40))}


def test_block_list_and_channel_index(spark):
    base, page = listing.BASE, listing.PAGE
    image = bytearray(base + listing.CHANNELS + 40 * page)
    blocks = [(0, T, 5, 1), (0, 3, 6, 1), (9, T, 7, 1), (0, T + 5, 8, 2)]
    for n, (reserved, t, block, group) in enumerate(blocks):
        image[base + listing.BLOCKS + 16 * n : base + listing.BLOCKS + 16 * n + 14] = struct.pack("<III", reserved, t, 77) + bytes([block, group])
    start = listing.CHANNELS // page + 8
    image[base + start * page : base + start * page + 4] = b"\x82\x80\x01\x00"
    index = [(1, 0x00, 3, T, start), (2, 0x20, 2, T, start + 1), (3, 0x10, 2, T, start), (4, 0, 0, T, start), (5, 0, 1, 3, start), (6, 0, 1, T, 1 << 20), (7, 0x20, 1, T, start)]
    for n, (ch, kind, length, t, at) in enumerate(index):
        image[base + listing.CHANNELS + 16 * n : base + listing.CHANNELS + 16 * n + 16] = struct.pack("<BBHII4x", ch, kind, length, t, at)
    for chunk in (4099, 1 << 20):
        chunks = images.chunked(spark.createDataFrame([(1, bytes(image)), (2, b"short")], "img long, bytes binary"), chunk)
        rows = sorted((r.n, r.start, r.block, r.grp, r.valid) for r in listing.block_list(chunks).collect())
        assert rows == [(n, t, block, group, r == 0 and t > 100) for n, (r, t, block, group) in enumerate(blocks)]
        got = {r.channel: (r.s, r.e, r.reason) for r in listing.channel_index(chunks, False).collect()}
        place = base + start * page
        assert got == {1: (place, place + 3 * page, None), 2: (place + page, place + 3 * page, "no_header_at_start"), 3: (place, place + 2 * page, "bad_stream_type"), 4: (place, place, "bad_stream_type"), 5: (place, place + page, "bad_stream_type"), 6: (base + (page << 20), base + (page << 20) + page, "beyond_image"), 7: (place, place + page, None)}
        assert {r.reason for r in listing.channel_index(chunks, True).collect()} == {"before_video", "bad_stream_type", "beyond_image"}


# ---- trees


def tree(entries_of_pages, start=16, stride=8, extra=(), stated=None, last=None, page1=None, magic=b"HIKBTREE", total=None, at=0, pages_at=None):
    """A tree of base 0x2000 + at: header, page list, footer, then pages."""
    base = 0x2000 + at
    plist, foot, first = base + 0x200, base + 0x400, base + 0x1000
    places = [first + k * 4096 for k in range(len(entries_of_pages))] if pages_at is None else pages_at
    listed = [*places, *extra]
    body = bytearray(0x1000 + 4096 * (len(entries_of_pages) + 4))
    body[:8] = magic
    body[0x2C:0x50] = struct.pack("<IQQQQ", T, foot, 0, plist, listed[0] if page1 is None and listed else page1 or first)
    body[0x200 : 0x200 + 8] = struct.pack("<Q", len(listed) if total is None else total)
    for k, o in enumerate(listed):
        body[0x208 + k * stride : 0x208 + k * stride + 8] = struct.pack("<Q", o)
    body[0x400:0x408] = struct.pack("<Q", (listed[-1] if listed else 0) if last is None else last)
    for k, slots in enumerate(entries_of_pages):
        for j, slot in enumerate(slots):
            o = 0x1000 + k * 4096 + start + 48 * j
            body[o : o + 48] = slot
    return bytes(body)


def slot(block, channel=1, exists=True, begin=T, end=T + 9, mixed=False):
    flag = b"\0\xff" * 4 if mixed else (b"\0" if exists else b"\xff") * 8
    return bytes(8) + flag + bytes([0, channel]) + bytes(6) + struct.pack("<IIQ", begin, end, block) + bytes(8)


def test_trees(spark):
    lo, hi = 0x100000, 0x200000
    pages = [[slot(0x100000, 1), slot(0x180000, 2, False), bytes(48), slot(0x120000, 3)], [slot(0x9999), slot(0x130000, 4), slot(0x140000, 5, mixed=True)]]
    base, first = 0x2000, 0x3000
    made = {
        1: tree(pages), 2: tree(pages, start=40, stride=16), 3: tree(pages, extra=[first, base, base + 0x200]), 4: tree(pages, extra=[1 << 40], last=5), 5: tree(pages, magic=b"HIKBTREF"),
        6: tree(pages, page1=first + 4096), 7: tree(pages, total=3000), 8: tree(pages, page1=1 << 50), 9: tree([]), 10: tree([[bytes([255] * 48)]]), 11: tree(pages, pages_at=[first, first]),
    }
    rows = [(k, bytes(base) + body) for k, body in made.items()] + [(12, b"tiny")]
    places = [(k, "one", base, len(made.get(k, b"x" * 9)), lo, hi) for k, _ in rows]
    for chunk in (999, 1 << 20):
        chunks = images.chunked(spark.createDataFrame(rows, "img long, bytes binary"), chunk)
        heads = listing.trees(chunks, spark.createDataFrame(places, "img long, tree string, base long, size long, lo long, hi long"))
        listed, faults = listing.page_list(chunks, heads)
        found = sorted((r.img, r.fault) for r in faults.collect())
        assert found == [(4, "footer differs from the last page"), (5, "signature"), (6, "page 1 differs from the header's"), (7, "absurd page count"), (8, "page 1 outside"), (12, "unusable")]
        verdicts = {}
        for r in listed.collect():
            verdicts.setdefault(r.img, []).append((r.k, r.verdict))
        assert {k: [v for _, v in sorted(x)] for k, x in verdicts.items()} == {1: [None] * 2, 2: [None] * 2, 3: [None, None, "repeats", "repeats", "repeats"], 4: [None, None, "outside"], 6: [None] * 2, 10: [None], 11: [None, "repeats"]}
        entries, best = listing.tree_entries(chunks, listed, heads)
        got = {}
        for r in entries.collect():
            got.setdefault(r.img, []).append((r.place, r.block, r.channel, r.exists))
        want = [(0x100000, 1, True), (0x180000, 2, False), (0x120000, 3, True), (0x130000, 4, True)]
        assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: want for k in (1, 2, 3, 4, 6)} | {11: want[:3]}
        assert {r.img: (r.start, r.n_ok, r.n_bad) for r in best.collect()} == {1: (16, 4, 2), 2: (40, 4, 2), 3: (16, 4, 2), 4: (16, 4, 2), 6: (16, 4, 2), 11: (16, 3, 0)}


def test_tree_against_its_backup(spark):
    rows = [(1, t, 7, 1, True, T, T) for t in ("one", "two")] + [(1, "one", 8, 1, True, T, T), (1, "two", 9, 1, True, T, T), (1, "two", 9, 1, True, T, T)]
    df = spark.createDataFrame(rows, "img long, tree string, block long, channel int, exists boolean, begin long, end long")
    assert sorted((r.block, r.n) for r in listing.tree_differences(df, "one", "two").collect()) == [(8, 1), (9, -2)]
