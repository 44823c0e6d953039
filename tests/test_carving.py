"""Codec headers, units and clips: hand-made streams with known answers, and a plain pass over whole images."""

import random
import re

import pytest

from spanloom.operators import bits, carving
from spanloom.session import written
from spanloom.sources import images
from tests import streams as S

# ---- headers


def test_sequence_parameter_sets():
    good = [S.sps264(3, 66), S.sps264(1, 100, scaling=True), S.sps264(2, 244, chroma=3, scaling=True, poc=0), S.sps264(0, 77, 120, 68, 9, poc=1)]
    f = bits.h264_sps([*good, S.sps264(0, 99), S.sps264(0, 66, level=14), b"\x67", b"", b"\x67" + bytes(40), good[0][:4]])
    assert f["valid"].tolist() == [True] * 4 + [False] * 6
    assert f["id"][:4].tolist() == [3, 1, 2, 0] and f["frame_num_bits"][:4].tolist() == [4, 4, 4, 9] and f["width"][:4].tolist() == [20, 20, 20, 120] and f["height"][3] == 68
    assert f["read"].tolist() == [True] * 6 + [False] * 4


def test_other_parameter_sets():
    f = bits.h264_pps([S.pps264(5, 3), S.pps264(300, 0), b"\x68", S.pps264()[:2]])
    assert f["valid"].tolist() == [True, False, False, False] and (f["id"][0], f["refers"][0]) == (5, 3) and f["read"][3]
    assert bits.h265_vps([S.vps265(4), S.vps265(4)[:4], b"\x40\x01" + bytes(6)])["valid"].tolist() == [True, False, False]
    f = bits.h265_sps([S.sps265(2, 4), S.sps265(2, 4, 4, 4), S.sps265(0, 0, layers=2)])
    assert f["valid"].tolist() == [True, False, True] and f["id"].tolist()[::2] == [2, -1] and (f["width"][0], f["height"][0], f["refers"][0]) == (320, 240, 4)
    f = bits.h265_pps([S.pps265(7, 2), S.pps265(64, 0), S.pps265(0, 16)])
    assert f["valid"].tolist() == [True, False, False] and (f["id"][0], f["refers"][0]) == (7, 2)


def test_numbers_of_random_bits():
    """Against a reader of text; none may raise, whatever the bytes."""
    rng = random.Random(1)
    rows = [bytes(rng.choice([0, 0, 1, 255, rng.randrange(256)]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    r = bits.Bits(rows, 0)
    got = [r.ue(), r.u(3), r.se(), r.u(0), r.ue()]
    for k, data in enumerate(rows):
        text = "".join(format(x, "08b") for x in data.replace(b"\0\0\3", b"\0\0"))
        at, values = 0, []

        def number():
            nonlocal at
            zeros = text.find("1", at) - at
            if zeros < 0 or zeros > 32 or at + 2 * zeros + 1 > len(text):
                return None
            at += 2 * zeros + 1
            return int(text[at - zeros - 1 : at], 2) - 1

        for kind in "u3s0u":
            if kind in "us":
                v = number()
                v = v if v is None or kind == "u" else (v + 1) // 2 if v % 2 else -(v // 2)
            else:
                v = int(text[at : at + int(kind)] or "0", 2) if at + int(kind) <= len(text) else None
                at += int(kind)
            values.append(v)
            if v is None:
                break
        assert bool(r.ok[k]) == (values[-1] is not None)
        assert [int(g[k]) for g in got][: len(values) - (values[-1] is None)] == [v for v in values if v is not None]
    for reader in (*bits.READERS.values(), bits.h264_slice):
        assert len(reader(rows)["read"]) == len(rows)


def test_parameter_and_slice_columns(spark):
    rng = random.Random(4)
    rows = [(1, "h264", "sps", 7, S.sps264(3)), (2, "h264", None, 5, S.slice264(rng, 0, True, 9)), (3, "h265", None, 19, S.slice265(rng, True, 6)), (4, "h264", "pps", 8, b""), (5, None, None, None, None), (6, "h264", None, 1, b"\x41")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, codec string, part string, type int, raw binary, kind string")
    got = {r.id: r for r in bits.slices(bits.parameter_sets(df), "raw").collect()}
    assert got[1].parameter.id == 3 and got[1].parameter.valid and got[4].parameter is None and got[5].parameter is None
    assert (got[2].kind, got[2].pps, got[3].kind, got[3].pps) == (7, 9, None, 6) and got[6].pps is None and got[5].kind is None


# ---- units and clips


def plain_units(data):
    """(start, end, header bytes) of each unit, by one pass over the image."""
    out, pending = [], None
    for m in re.finditer(rb"\x00\x00+\x01|\x00\x00\x00+", data):
        s, e = m.span()
        if data[e - 1] != 1:
            if pending is not None and s > pending[1]:
                out.append((pending[0], s, pending[1]))
                pending = None
        elif e < len(data):
            if pending is not None and s > pending[1]:
                out.append((pending[0], s, pending[1]))
            pending = (e - (4 if e - s >= 4 else 3), e)
    if pending is not None:
        tail = data[max(pending[1], len(data) - 2) :]
        out.append((pending[0], max(pending[1] + 1, len(data) - (len(tail) - len(tail.rstrip(b"\0")))), pending[1]))
    return [(s, e, data[h : h + carving.HEAD], data[h : min(e, s + carving.RAW)]) for s, e, h in out]


def plain_clips(spark, made, rules):
    """The rules along all units of each image at once."""
    rows = [(img, s, e, h, r if carving.parameter_kind(h) else None) for img, data in made.items() for s, e, h, r in plain_units(data)]
    units = carving.described(spark.createDataFrame(rows, "img string, at long, end long, head binary, raw binary")).collect()
    out = {}
    for img in made:
        walk = carving.Walk(None, rules)
        for u in sorted((r.asDict(recursive=True) for r in units if r.img == img), key=lambda r: r["at"]):
            walk.unit(u)
        walk.leave()
        out[img] = sorted((p["kind"], p["codec"], tuple(zip(p["s"], p["e"])), p["units"], p["pictures"], p["access"], p["reason"] or "end of image") for p in walk.pieces)
    return out


def chunks(spark, data, size):
    return images.chunked(spark.createDataFrame([(1, data)], "img int, bytes binary"), size, carving.RAW)


def carved(df, rules=carving.Rules(), block=carving.BLOCK, span=carving.SPAN):
    return sorted((r.kind, r.codec, tuple((x.s, x.e) for x in r.extents), r.units, r.pictures, r.random_access, r.reason) for r in carving.carve(df, rules, block, span).collect())


PAD = b"\0" * 4096
CLEAN = S.clip264(1)


def images_of_test():
    rng = random.Random(9)
    lost = S.stream([S.slice264(rng, k) for k in range(5)], rng)
    jump = S.stream([S.sps264(), S.pps264(), S.slice264(rng, 0, True), S.slice264(rng, 1), S.slice264(rng, 9), S.slice264(rng, 10)])
    foreign = S.stream([S.sps264(), S.pps264(), S.slice264(rng, 0, True), S.slice264(rng, 1, pps=4), S.slice264(rng, 2)])
    broken = S.stream([S.sps264(0, 99), S.pps264(), S.slice264(rng, 0, True)])
    junk = S.stream([S.sps264(), S.pps264(), S.slice264(rng, 0, True), b"\xff\xfejunk", S.slice264(rng, 1), b"\x09\x10", S.slice264(rng, 2)])
    return {
        "clean": CLEAN, "clean265": S.clip265(2), "padded": S.noise(1, 3000) + PAD + CLEAN + PAD + S.noise(2, 1000), "two": CLEAN + bytes(100) + S.clip264(3, profile=100),
        "changed": CLEAN + S.clip264(4, width=40), "lost": PAD + lost + PAD, "jump": jump, "foreign": foreign, "broken": broken, "junk": junk,
        "mixed": S.clip265(5) + lost + CLEAN + bytes(65) + lost, "zeros": bytes(5000), "none": S.noise(3, 3000), "code": b"\0\0\1", "head": b"\0\0\1\x67", "tail": CLEAN + b"\0\0", "start": CLEAN + b"\0\0\1",
        "odd": b"\0\0\1\0\0\0\1" + CLEAN + b"\0\0\1\0\0\0\0\0" + lost, "long": S.clip264(7, 400, 25) + S.clip264(8, 300, 300, repeat=False, frame_bits=6) + bytes(70) + S.clip265(6, 200, 40),
    }


def test_known_answers(spark):
    made = {k: v for k, v in images_of_test().items() if k in ("clean", "clean265", "padded", "two", "changed", "lost", "jump", "foreign", "broken", "junk", "zeros", "none")}
    found = carving.carve(images.chunked(spark.createDataFrame(list(made.items()), "img string, bytes binary"), 1 << 16, carving.RAW)).collect()
    rows = {k: sorted((r.kind, r.codec, tuple((x.s, x.e) for x in r.extents), r.units, r.pictures, r.random_access, r.reason) for r in found if r.img == k) for k in made}
    size = len(CLEAN)
    assert rows["clean"] == [("clip", "h264", ((0, size),), 16, 12, 2, "end of image")]
    assert [(r[1], r[5]) for r in rows["clean265"]] == [("h265", 2)]
    assert rows["padded"][0][:3] == ("clip", "h264", ((3000 + 4096, 3000 + 4096 + size),)) and len(rows["padded"]) == 1
    assert [r[2][0][0] for r in rows["two"]] == [0, size + 100] and rows["two"][0][6] == "gap of 100 bytes"
    assert [r[2][0][0] for r in rows["changed"]] == [0, size] and rows["changed"][0][6] == "parameter sets changed"
    assert [(r[0], r[3], r[6]) for r in rows["lost"]] == [("orphan", 5, carving.FRAGMENT)]
    assert [(r[0], r[4]) for r in rows["jump"]] == [("clip", 2), ("orphan", 0)] and rows["jump"][0][6].startswith("frame_num")
    assert rows["foreign"][0][6] == "slice references a PPS not seen in the clip" and rows["foreign"][1][3] == 2
    assert [(r[0], r[6]) for r in rows["broken"]] == [("orphan", carving.NO_SETS)]
    assert [(r[0], r[4]) for r in rows["junk"]] == [("clip", 3)] and rows["zeros"] == rows["none"] == []


@pytest.mark.parametrize(("chunk", "block"), [(97, 500), (1000, 4096), (1 << 20, 1 << 24)])
def test_blocks_equal_one_pass(spark, chunk, block):
    made = images_of_test()
    joined = {k: v for k, v in made.items() if chunk > 97 or len(v) < 4000 or k == "long"}
    df = images.chunked(spark.createDataFrame([(k, v) for k, v in joined.items()], "img string, bytes binary"), chunk, carving.RAW)
    units = sorted((r.img, r.at, r.end, bytes(r.head), bytes(r.raw or b"")) for r in carving.nal_units(df, 8 * chunk).collect())
    assert units == sorted((k, s, e, h, r if carving.parameter_kind(h) else b"") for k, v in joined.items() for s, e, h, r in plain_units(v))
    got = {}
    for r in carving.carve(df, carving.Rules(), block, 8 * block).collect():
        got.setdefault(r.img, []).append((r.kind, r.codec, tuple((x.s, x.e) for x in r.extents), r.units, r.pictures, r.random_access, r.reason))
    assert {k: sorted(got.get(k, [])) for k in joined} == plain_clips(spark, joined, carving.Rules())


def test_fragments_joined_across_a_gap(spark):
    rng = random.Random(2)
    first = S.stream([S.sps264(), S.pps264(), S.slice264(rng, 0, True), S.slice264(rng, 1)])
    second = S.stream([S.slice264(rng, k) for k in range(2, 6)])
    data = first + bytes(3000) + second
    rules = carving.Rules(join_gap=5000)
    for block in (64, 1 << 20):
        rows = carved(chunks(spark, data, 700), rules, block)
        assert rows == plain_clips(spark, {"one": data}, rules)["one"] == [("clip", "h264", ((0, len(first)), (len(first) + 3000, len(data))), 8, 6, 1, "end of image")]
    assert [r[0] for r in carved(chunks(spark, data, 700))] == ["clip", "orphan"]


def test_rounds_are_few_where_sets_repeat(spark):
    data = S.clip264(7, 2000, 10)
    units = written(carving.described(carving.nal_units(chunks(spark, data, 1 << 16))).selectExpr("*", "at div 8192 as block"))
    pieces, rounds = carving.block_pieces(units, carving.Rules())
    assert units.select("block").distinct().count() > 12 and rounds <= 3 and pieces.where("opens").count() == 1
    assert carving.carve(spark.createDataFrame([], "img int, pos long, data binary, before binary, after binary")).count() == 0


def test_blocks_are_walked_along_partitions(spark, capsys):
    units, entries = spark.createDataFrame([], "img long, block long, at long"), spark.createDataFrame([], "img long, block long, entry string")
    carving.walked(units, entries, carving.Rules()).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "GroupsInArrow" not in plan  # a call for each block takes longer than its rules
