"""Chains, framed streams, total orders, uncertain order, suppression and canonical logs against plain versions."""

import hashlib
import json
import os
import random
import struct

import numpy as np
import pytest

from spanloom.operators import bytestream, canonical, framing, intervals, matching, measuring, ordering, pointers, suppression
from spanloom.operators.records import GENESIS
from spanloom.sources import images
from tests.streams import noise

# ---- pointer doubling


def test_ends_of_chains(spark):
    n = 10_000
    rows = [(k, k + 1 if k + 1 < n else None) for k in range(n)] + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_003, 20_001), (30_000, 77_777), (40_000, 40_000)]
    ends, rounds = pointers.chain_ends(spark.createDataFrame(rows, "id long, next long"))
    got = {r.id: (r.last, r.steps, r.circular) for r in ends.collect()}
    assert rounds <= 15 and got[0] == (n - 1, n - 1, False) and got[n - 1] == (n - 1, 0, False) and got[30_000] == (30_000, 0, False)
    assert all(got[k] == (None, None, True) for k in (20_000, 20_001, 20_002, 20_003, 40_000))
    assert all(got[k] == (n - 1, n - 1 - k, False) for k in range(0, n, 97))
    ends, _ = pointers.chain_ends(spark.createDataFrame([], "id long, next long"))
    assert ends.count() == 0


def test_latest_attempts(spark):
    rng = random.Random(6)
    jobs = [(k, rng.choice([None, rng.randrange(k), k - 1]) if k else None) for k in range(400)]
    nxt = {}
    for k, of in jobs:
        if of is not None:
            nxt[of] = max(k, nxt.get(of, k))
    got = {r.id: (r.latest, r.attempts) for r in pointers.latest_attempts(spark.createDataFrame(jobs, "id long, retry_of long")).collect()}
    for k, _ in jobs:
        at, steps = k, 0
        while at in nxt:
            at, steps = nxt[at], steps + 1
        assert got[k] == (at, steps)


def test_reachable(spark):
    rows = [(k, k + 1 if k % 1000 != 999 else None) for k in range(3000)]
    seen, rounds = pointers.reachable(spark.createDataFrame(rows, "id long, next long"), spark.createDataFrame([(5,), (1990,)], "id long"))
    assert {r.id for r in seen.collect()} == {*range(5, 1000), *range(1990, 2000)} and rounds <= 12


# ---- framed streams


def frame(kind, channel, number, payload=b"", codec=None, size=None, date=0, ext=None, length=None, trailer=True):
    tlv = b"" if codec is None else bytes([0x81, 0, codec, 25])
    tlv += b"" if size is None else bytes([0x82, 0, 0, 0]) + struct.pack("<HH", *size)
    tlv = tlv if ext is None else ext
    total = 24 + len(tlv) + len(payload) + 8 if length is None else length
    head = b"DHAV" + bytes([kind, 1, channel, 0]) + struct.pack("<III", number, total, date) + struct.pack("<H", 7) + bytes([len(tlv), 0])
    return head + tlv + payload + (b"dhav" + struct.pack("<I", total - 8 & 0xFFFFFFFF) if trailer else b"")


def plain_walk(data):
    """Frames and rejections of one sequential pass: (places met, runs, reasons)."""
    found, runs, reasons = [], [], {}

    def read(at):
        h = data[at : at + 24]
        if len(h) < 24:
            return "truncated header"
        if h[:4] != b"DHAV":
            return "magic"
        if h[4] not in (0xF0, 0xF1, 0xFC, 0xFD):
            return f"unknown frame type 0x{h[4]:02x}"
        length = struct.unpack_from("<I", h, 12)[0]
        if not 24 <= length <= framing.LONGEST or at + length > len(data):
            return f"frame length {length} out of range or beyond the image"
        if data[at + length - 8 : at + length] != b"dhav" + struct.pack("<I", length - 8):
            return "trailer missing or length mismatch"
        taken = framing.extension(data[at + 24 : at + 24 + h[22]])[1]
        if h[4] != 0xF1 and at + 24 + taken > at + length - 8:
            return "extension overruns the frame"
        return length

    pos = 0
    while (at := data.find(b"DHAV", pos)) >= 0:
        length = read(at)
        if isinstance(length, str):
            reasons[length] = reasons.get(length, 0) + 1
            pos = at + 1
            continue
        runs.append([])
        while isinstance(length, int):
            found.append(at)
            runs[-1].append(at)
            at += length
            length = read(at) if at + 24 <= len(data) else "magic"
        if length != "magic":
            reasons[length] = reasons.get(length, 0) + 1
        pos = at
    return found, runs, reasons


def plain_channels(data, tolerance=3):
    _, runs, _ = plain_walk(data)
    out, pending = [], {}
    for run in runs:
        active = {}

        def close(ch, why, active=active):
            if (a := active.pop(ch, None)) is not None:
                out.append((ch, "clip", a["s"], a["e"], a["n"], a["keys"], a["codec"], why))

        for at in run:
            kind, ch, ext = data[at + 4], data[at + 6], data[at + 22]
            number, length = struct.unpack_from("<II", data, at + 8)
            if kind not in (0xFC, 0xFD):
                continue
            info, taken = framing.extension(data[at + 24 : at + 24 + ext])
            codec, size = framing.CODECS.get(info.get("codec")), (info.get("width"), info.get("height"))
            p0, p1 = at + 24 + taken, at + length - 8
            a = active.get(ch)
            if a is not None:
                changed = kind == 0xFD and (codec and codec != a["codec"] or size[0] and size != a["size"])
                if (number - a["last"]) % (1 << 32) > tolerance + 1 or changed:
                    close(ch, "codec/resolution change" if changed else "frame_number discontinuity")
                    a = None
            if a is None:
                if kind != 0xFD:
                    o = pending.get(ch)
                    if o is not None and at - o["e"] <= 64 + length:
                        o["e"], o["n"] = p1, o["n"] + 1
                    else:
                        pending[ch] = o = {"s": p0, "e": p1, "n": 1}
                        out.append((ch, "orphan", o))
                    continue
                pending.pop(ch, None)
                a = active[ch] = {"s": p0, "n": 0, "keys": 0, "codec": codec or "unknown", "size": size}
            a |= {"e": p1, "n": a["n"] + 1, "keys": a["keys"] + (kind == 0xFD), "last": number}
        for ch in list(active):
            close(ch, "end of contiguous DHAV frame run")
    return sorted(x if x[1] == "clip" else (x[0], "orphan", x[2]["s"], x[2]["e"], x[2]["n"], 0, None, "non-key video frames without a preceding key frame") for x in out)


def framed_image(seed):
    rng, numbers = random.Random(seed), [0] * 3
    out = bytearray(noise(seed, rng.randint(0, 200)))
    for _ in range(rng.randint(20, 70)):
        what, ch = rng.random(), rng.randrange(3)
        numbers[ch] += rng.choice([1, 1, 1, 1, 2, 9])
        body = rng.choice([b"\0\0\1e", b"\0\0\0\1", b"xx"]) + noise(rng.random(), rng.randint(0, 300))
        if what < 0.2:
            out += frame(0xFD, ch, numbers[ch], body, rng.choice([2, 4, 12]), rng.choice([(320, 240), (640, 480)]))
        elif what < 0.7:
            out += frame(0xFC, ch, numbers[ch], body)
        elif what < 0.76:
            out += frame(rng.choice([0xF0, 0xF1]), ch, numbers[ch], body)
        elif what < 0.8:
            out += frame(0xFC, ch, numbers[ch], b"pDHAV" + frame(0xFC, ch, 3, b"inner") + body)  # frames within a frame's payload
        elif what < 0.84:
            out += frame(0xEE, ch, 1, body)
        elif what < 0.88:
            out += frame(0xFC, ch, 1, body, length=rng.choice([3, 1 << 25, 600]))
        elif what < 0.91:
            out += frame(0xFC, ch, numbers[ch], body, trailer=False)
        elif what < 0.94:
            out += frame(0xFC, ch, 1, ext=bytes([0x99] + [0] * 30), length=40)
        else:
            out += noise(rng.random(), rng.randint(1, 150))
    return bytes(out) + rng.choice([b"", b"DHAV", b"DHAVxxxx", b"\0" * 30])


@pytest.mark.parametrize("chunk", [64, 701, 1 << 16])
def test_frames_equal_a_sequential_walk(spark, chunk):
    made = {k: framed_image(k) for k in range(6 if chunk > 64 else 2)} | {90: b"", 91: b"nothing here"}
    df = images.chunked(spark.createDataFrame(list(made.items()), "img long, bytes binary"), chunk, framing.OVERLAP)
    met, rounds = framing.frames(df, span=8 * chunk)
    rows = met.collect()
    for k, data in made.items():
        found, runs, reasons = plain_walk(data)
        own = sorted((r.at, r.run) for r in rows if r.img == k and r.reason is None)
        assert own == [(at, run[0]) for run in runs for at in run] and [x for x, _ in own] == found
    assert rounds <= 10
    got = {}
    for r in framing.rejections(met).collect():
        got.setdefault(r.img, {})[r.reason] = r.n
    assert got == {k: r for k, data in made.items() if (r := plain_walk(data)[2])}
    clips = {}
    for r in framing.channel_clips(met, span=8 * chunk).collect():
        clips.setdefault(r.img, []).append((r.channel, r.kind, r.s, r.e, r.frames, r.keys, r.codec, r.reason))
    assert {k: sorted(v) for k, v in clips.items()} == {k: v for k, data in made.items() if (v := plain_channels(data))}


def test_short_clips_and_dates(spark):
    data = frame(0xFD, 1, 1, b"abc", 4, (320, 240), date=5 | 6 << 6 | 7 << 12 | 8 << 17 | 9 << 22 | 24 << 26) + frame(0xFC, 1, 2, b"d")
    met, _ = framing.frames(images.chunked(spark.createDataFrame([(1, data)], "img long, bytes binary"), 50, framing.OVERLAP))
    r = framing.channel_clips(met, least=3).withColumn("date", framing.frame_date("first_date")).first()
    assert (r.kind, r.reason, r.frames) == ("orphan", "clip too short", 2)
    assert r.date == "2024-09-08 07:06:05"


# ---- order


def test_total_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1, 2, 2]), rng.randrange(50)) for k in range(3000)]
    got = ordering.total_order(spark.createDataFrame(rows, "id long, a int, b int").repartition(7), [F.col("a").isNull(), F.col("a"), F.col("b"), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.order)] == [r[0] for r in want] and sorted(r.order for r in got) == list(range(1, 3001))
    assert ordering.total_order(spark.createDataFrame([], "id long"), [F.col("id")]).count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_first_beyond(spark, block):
    rng = random.Random(block)
    values = [(k, rng.randrange(1000)) for k in range(700)]
    asks = sorted({(rng.randrange(700), rng.randrange(1010)) for _ in range(900)} | {(k, v) for k, v in values})
    got = sorted(tuple(r) for r in ordering.first_beyond(spark.createDataFrame(values, "place long, value long"), spark.createDataFrame(asks, "place long, bound long"), 701, block).collect())
    assert got == [(p, b, next((k for k, v in values[p + 1 :] if v > b), None)) for p, b in asks]


def bars_of(rng, n):
    rows = []
    for k in range(n):
        at, wide, long = rng.randrange(-3_000, 3_000), rng.choice([0, 2, 10, 400]), rng.randrange(0, 120)
        end = rng.choice([0, 2, 60])
        rows.append((k, rng.randrange(3), rng.choice([None, 1, 2]), at, at + wide, at + long, at + long + max(wide - long, 0) + end))
    return rows


def test_order_gaps_and_overlaps_of_bars(spark):
    rng = random.Random(4)
    rows = [*bars_of(rng, 400), (999, 1, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ordering.BAR))
    ordered = ordering.bars_in_order(df)
    want = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3] + r[4], r[5] + r[6], r[1], r[2] is None, r[2] or 0, r[0]))
    assert [r.clip_id for r in ordered.orderBy("order").collect()] == [r[0] for r in want]
    pairs = []
    for i, a in enumerate(want):
        for b in want[i + 1 :]:
            if b[3] > a[4]:
                break
            pairs.append((a[0], b[0]))
    assert sorted(tuple(r) for r in ordering.ambiguous_order(ordered).collect()) == sorted(pairs) and pairs
    gaps, lanes = [], {}
    for r in want:
        lanes.setdefault((r[1], r[2]), []).append(r)
    for seq in lanes.values():
        for a, b in zip(seq, seq[1:]):
            nominal = (b[3] + b[4] - a[5] - a[6]) / 2
            if nominal > 5:
                gaps.append((a[1], a[2], a[0], b[0], nominal, b[3] - a[6], b[4] - a[5], b[3] - a[6] > 0))
    assert sorted((tuple(r) for r in ordering.bar_gaps(ordered, 5).collect()), key=str) == sorted(gaps, key=str) and gaps
    laps = []
    for i, a in enumerate(want):
        for b in want[i + 1 :]:
            if b[3] + b[4] >= a[5] + a[6]:
                break
            nominal = (min(a[5] + a[6], b[5] + b[6]) - max(a[3] + a[4], b[3] + b[4])) / 2
            if nominal > 0:
                sure = min(a[5], b[5]) - max(a[4], b[4])
                laps.append((a[0], b[0], "same_channel" if a[1:3] == b[1:3] else "cross_channel", nominal, max(0, sure), sure > 0))
    assert sorted(tuple(r) for r in ordering.bar_overlaps(ordered, 64).collect()) == sorted(laps) and laps


def paired_last(spark, df):
    """Whether no shuffle lies over the place where a plan explodes its pairs, with nothing broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return "Exchange" not in plan[: plan.index("Generate explode")]


def test_uncertain_pairs_are_never_shuffled(spark):
    rng = random.Random(14)
    rows = [*bars_of(rng, 150), (5000, 1, 1, -900, 4000, 4000, 5000)]
    ordered = ordering.bars_in_order(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ordering.BAR)))
    want = sorted(tuple(r) for r in ordering.ambiguous_order(ordered).collect())
    last = ordering.last_uncertain(ordered)
    for run in (1, 7, 64):
        assert sorted(tuple(r) for r in ordering.pairs_behind(ordered, last, ["clip_id"], run).collect()) == want
    assert paired_last(spark, lambda: ordering.ambiguous_order(ordered))


def test_nominal_overlaps_are_never_shuffled(spark):
    df = spark.createDataFrame(bars_of(random.Random(15), 150), ", ".join(f"{c} long" for c in ordering.BAR))
    ordered = ordering.bars_in_order(df)
    met = [sorted(tuple(r) for r in ordering.bar_overlaps(ordered, run).collect()) for run in (3, 1024)]
    assert met[0] == met[1] and met[0]
    assert paired_last(spark, lambda: ordering.bar_overlaps(ordered))


def test_written_tables_leave_no_shuffles(spark):
    import time
    from pathlib import Path

    from spanloom.session import removed, written

    folders = [Path(p) for p in (os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir")).split(",")]
    files = lambda: {f for p in folders for f in p.rglob("shuffle_*.data")}
    before = files()
    table = written(spark.range(5000).repartition(3, "id"))
    for _ in range(50):
        if left := files() - before:
            time.sleep(0.2)
    assert not left and table.count() == 5000
    removed(table)


def test_uncertain_lists_without_pairs_as_rows(spark):
    rng = random.Random(16)
    rows = [*bars_of(rng, 120), (5000, 1, 1, -900, 4000, 4000, 5000)]
    ordered = ordering.bars_in_order(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ordering.BAR)))
    places = {r.clip_id: r.order for r in ordered.collect()}
    others = {k: [] for k in places}
    for r in ordering.ambiguous_order(ordered).collect():
        others[r.a].append(r.b)
        others[r.b].append(r.a)
    want = {k: ";".join(str(x) for x in sorted(v, key=places.get)) or None for k, v in others.items()}
    for run in (1, 7, 1024):
        listed = ordering.ambiguous_lists(ordered, run)
        assert {r.clip_id: r.ambiguous_order_with for r in listed.collect()} == want and listed.columns == [*ordered.columns, "ambiguous_order_with"]


def test_export(spark, tmp_path):
    import csv

    rng = random.Random(8)
    df = spark.createDataFrame([(*r, ["b", "a"], None if r[0] % 2 else "x,\"y\"") for r in bars_of(rng, 60)], ", ".join(f"{c} long" for c in ordering.BAR) + ", flags array<string>, engine string")
    ordered = ordering.bars_in_order(df)
    rows = ordering.export_rows(ordered, df.limit(5).withColumn("unplaceable_reason", ordering.F.lit("no_timestamp")), ordering.ambiguous_order(ordered))
    path = str(tmp_path / "out")
    ordering.write_export(rows.repartition(3), path)
    lines = []
    for name in sorted((tmp_path / "out").glob("*.csv")):
        with open(name, newline="") as f:
            table = list(csv.DictReader(f))
        lines += table
    assert list(lines[0]) == ordering.EXPORT and len(ordering.EXPORT) == 49 and len(lines) == 65
    assert [int(x["order"]) for x in lines[:60]] == list(range(1, 61)) and [x["placement"] for x in lines[60:]] == ["unplaceable"] * 5
    assert [int(x["clip_id"]) for x in lines[60:]] == sorted(int(x["clip_id"]) for x in lines[60:]) and lines[0]["flags"] == "b;a"
    other = {}
    for r in ordering.ambiguous_order(ordered).collect():
        other.setdefault(r.a, set()).add(str(r.b))
        other.setdefault(r.b, set()).add(str(r.a))
    assert all(set(filter(None, x["ambiguous_order_with"].split(";"))) == other.get(int(x["clip_id"]), set()) for x in lines[:60])


# ---- boxes


def plain_suppression(rows, threshold):
    kept = []
    for i, s, *box in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0])):
        x = np.array(box)

        def over(other, x=x):
            o = np.array(other)
            w, h = min(x[2], o[2]) - max(x[0], o[0]), min(x[3], o[3]) - max(x[1], o[1])
            both = max(w, 0) * max(h, 0)
            union = (x[2] - x[0]) * (x[3] - x[1]) + (o[2] - o[0]) * (o[3] - o[1]) - both
            return union > 0 and both / union > threshold

        if not any(over(k[2:]) for k in kept):
            kept.append((i, s, *box))
    return {k[0] for k in kept}


@pytest.mark.parametrize("threshold", [0.0, 0.45])
def test_suppression(spark, threshold):
    rng, rows = random.Random(1), []
    for img in range(4):
        for k in range(120):
            x, y, side = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0.0, 3.0, 20.0, 70.0])
            rows.append((img, k, rng.choice([None, 0.5, 0.5, 0.9, rng.random()]), x, y, x + side, y + side * rng.choice([1.0, 0.5])))
    df = spark.createDataFrame(rows, "img int, id long, score double, x1 double, y1 double, x2 double, y2 double")
    kept, rounds = suppression.suppress(df, ["img"], threshold)
    got = {}
    for r in kept.collect():
        got.setdefault(r.img, set()).add(r.id)
    assert got == {img: plain_suppression([r[1:] for r in rows if r[0] == img], threshold) for img in range(4)} and 1 < rounds < 40
    assert suppression.suppress(df.limit(0), ["img"], 0.5)[0].count() == 0


# ---- canonical logs


def test_canonical_text(spark):
    rng = random.Random(3)

    def value(depth=0):
        plain = [None, True, rng.randrange(-(10**20), 10**20), rng.random() * 10 ** rng.randrange(-20, 20), "".join(rng.choice("aé\"\\\n\u2028😀") for _ in range(4))]
        kind = rng.randrange(7 if depth < 3 else 5)
        return plain[kind] if kind < 5 else [value(depth + 1) for _ in range(2)] if kind == 5 else {f"k{rng.randrange(9)}": value(depth + 1) for _ in range(3)}

    values = [value() for _ in range(200)]
    rows = [(k, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for k, v in enumerate(values)] + [(900, "{bad"), (901, None), (902, "")]
    got = dict(tuple(r) for r in spark.createDataFrame(rows, "k long, t string").select("k", canonical.canonical("t")).collect())
    assert all(got[k] == json.dumps(v, sort_keys=True, separators=(",", ":")) for k, v in enumerate(values)) and got[900] is got[901] is got[902] is None


def test_chain_report(spark):
    def log(case, n):
        prev, out = GENESIS, []
        for seq in range(1, n + 1):
            e = {"case_id": case, "seq": seq, "timestamp_utc": f"2025-01-{seq:02d}", "action": "note", "evidence_id": None if seq % 2 else seq, "examiner": "é", "tool_version": "1", "ntp_status": "ok", "prev_hash": prev}
            details = {"b": seq, "a": [1.5, "x"]}
            prev = hashlib.sha256(json.dumps(e | {"v": 1, "details": details}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            out.append(e | {"details_json": json.dumps(details), "entry_hash": prev, "key_id": "k1"})
        return out

    clean, edited, cut, forged, torn = (log(c, 6) for c in range(5))
    edited[2]["action"] = "edited"
    del cut[3]
    forged[4]["key_id"] = "k2"
    torn[5]["details_json"] = "{"
    names = [*canonical.FIELDS, "details_json", "entry_hash", "key_id"]
    kind = "case_id long, seq long, timestamp_utc string, action string, evidence_id long, examiner string, tool_version string, ntp_status string, prev_hash string, details_json string, entry_hash string, key_id string"
    rows = [tuple(e[n] for n in names) for e in (*clean, *edited, *cut, *forged, *torn)]
    random.Random(1).shuffle(rows)
    got = sorted(tuple(r) for r in canonical.chain_report(spark.createDataFrame(rows, kind).repartition(5), "k1").collect())
    assert got == [
        (1, 3, "entry_hash does not match entry contents"), (2, 5, "prev_hash does not match previous entry_hash"), (2, 5, "sequence gap or reorder (expected 4)"),
        (2, 6, "sequence gap or reorder (expected 5)"), (3, 5, "signed with unknown key k2"), (4, 6, "details not parseable"),
    ]


def test_entries_are_hashed_once_they_are_in_order(spark, monkeypatch):
    seen = []
    order = canonical.total_order
    monkeypatch.setattr(canonical, "total_order", lambda rows, *args: seen.append(rows.columns) or order(rows, *args))
    kind = "case_id long, seq long, timestamp_utc string, action string, evidence_id long, examiner string, tool_version string, ntp_status string, prev_hash string, details_json string, entry_hash string, key_id string, note string"
    report = canonical.chain_report(spark.createDataFrame([(1, 1, "t", "note", None, "E", "1", "ok", GENESIS, "{", "x", "k1", "")], kind), "k1")
    assert [tuple(r) for r in report.collect()] == [(1, 1, "details not parseable")]
    assert len(seen) == 1 and "computed" not in seen[0] and "note" not in seen[0]  # ordering reads its rows twice


def test_units_to_carve_are_dealt_by_their_number(spark, monkeypatch):
    from spanloom.operators import along

    monkeypatch.setattr(along, "ROWS", 20)
    parts = {0: "sps", 1: "pps"}
    units = [(img, 64 * k, 64 * k + 60, parts.get(k), k > 1, k == 2) for img in range(50) for k in (*range(7), 3)]  # one comes twice
    found = bytestream.carved(spark.createDataFrame(units, "img int, at long, end long, part string, vcl boolean, random boolean"), 200)
    assert found.rdd.getNumPartitions() == 20  # not the session's 4, however many rows there are
    assert sorted(tuple(r) for r in found.collect()) == [(img, "clip", 0, 444, 7) for img in range(50)]


# ---- mended faults


def test_overlaps_before_zero(spark):
    rows = [(1, -10, 5), (2, -3, 2), (3, -2000, -1500), (4, -1600, -1024), (5, 7, 9), (6, -1024, -1)]
    df = spark.createDataFrame([(0, *r) for r in rows], "img int, id long, s long, e long")
    for width in (7, 1024):
        got = sorted((r.a, r.b, r.s, r.e) for r in intervals.overlap_pairs(df, ["img"], width).collect())
        assert got == [(1, 2, -3, 2), (3, 4, -1600, -1500), (6, 1, -10, -1), (6, 2, -3, -1)]
        best = {r.l: (r.r, r.overlap) for r in intervals.best_overlap(df.where("id < 3"), df.where("id >= 3"), ["img"], width).collect()}
        assert best == {1: (6, 9), 2: (6, 2)}
        shared = {(r.l, r.r): r.overlap for r in matching.extent_overlaps(df.where("id = 1"), df.where("id > 1"), ["img"], width).collect()}
        assert shared == {(1, 2): 5, (1, 6): 9}
        inside = matching.contained(spark.createDataFrame([(0, -1600, 10), (0, -5, 3), (0, -5, 99)], "img int, at long, length long"), df.where("id in (3, 4, 6)"), ["img"], width)
        assert sorted(r.at for r in inside.collect()) == [-1600, -5]


def test_bootstrap_of_small_keys(spark):
    df = spark.createDataFrame([("one", 1, 1, 2), ("none", 2, 0, 0), *(("many", k, k % 2, 1) for k in range(40))], "key string, unit long, k long, n long")
    got = {r.key: r for r in measuring.bootstrap(df, ["key"], "unit", "k", "n").collect()}
    assert got["one"].rate == got["one"].low == got["one"].high == 0.5 and got["none"].rate is None and got["none"].low is None and 0 < got["many"].low < 0.5 < got["many"].high


def test_damaged_numbers_ties_and_names(spark):
    from pyspark.sql import functions as F

    rows = [("0" * 70 + "1",), ("0" * 33 + "1" * 40,), ("0" * 32 + "1" + "0" * 32,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string").select(bytestream.exp_golomb(F.col("b"), F.lit(0))["value"]).collect()]
    assert got == [None, None, (1 << 32) - 1, None]
    box = "img int, id long, confidence double, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, 10, 0.0, 0.0, 0.0, 2.0, 2.0), (1, 11, 0.0, 0.0, 0.0, 2.0, 2.0)], box)
    assert matching.greedy_matches(spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 2.0, 2.0)], box), truth, ["img"]).first().truth_id == 11
    out = measuring.pooled_rates(spark.createDataFrame([("a", 1, 2)], "k string, x int, y int"), ["k"], {"m": ("x", "y")})
    assert out.columns == ["k", "metric", "_k", "n", "rate"] and out.first().rate == 0.5
