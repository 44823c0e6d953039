"""Matching, measuring, placement, byte-stream and streaming operators against plain Python and known answers."""

import hashlib
import random
import re
import zlib
from zoneinfo import ZoneInfo
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanloom.operators import bytestream, intervals, matching, measuring, placement, pointers, records, scoring, timeline
from spanloom.plans import bytestreams
from spanloom.plans import matching as matching_plans
from spanloom.plans import measuring as measuring_plans
from spanloom.sources import images
from spanloom.streaming import live

SMALL = "/root/testdata/sf0.001"


def test_wall_clocks_and_instants(spark):
    cases = [("2024-02-29 10:00:00", True), ("2023-02-29 10:00:00", False), (" 2024-01-02T03:04:05.5 ", True), ("2024-01-02 24:00:00", False), ("2024-01-02 03:04:60", False), ("2024-1-2 03:04:05", False), (None, False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.us for r in df.select("k", placement.parse_wall_clock(F.col("t")).alias("us")).collect()}
    assert [got[k] is not None for k in range(len(cases))] == [ok for _, ok in cases]
    assert got[2] == 1704164645_500000
    stamps = spark.createDataFrame([(0, "2024-01-01T00:00:00Z"), (1, "2024-01-01T02:00:00+02:00"), (2, "2024-01-01T00:00:00"), (3, None)], "k int, t string")
    assert [r.us for r in stamps.select("k", placement.parse_instant(F.col("t")).alias("us")).orderBy("k").collect()] == [1704067200000000] * 2 + [None] * 2


def test_candidates_against_zoneinfo(spark):
    """Every half hour about both changes of summer time."""
    zone, utc = ZoneInfo("Europe/Berlin"), timezone.utc
    walls = [datetime(2024, m, d) + timedelta(minutes=30 * k) for m, d in ((3, 31), (10, 27)) for k in range(12)]
    stored = [int(w.replace(tzinfo=utc).timestamp()) for w in walls]
    rows = spark.createDataFrame([(k, s, "unix_s", "Europe/Berlin", "device_local") for k, s in enumerate(stored)], "id int, raw long, format string, zone string, basis string")
    got = {r.id: r for r in placement.decode(rows, ["Europe/Berlin"]).collect()}
    for k, w in enumerate(walls):
        own = sorted({int(w.replace(tzinfo=zone, fold=f).timestamp()) for f in (0, 1) if w.replace(tzinfo=zone, fold=f).astimezone(utc).astimezone(zone).replace(tzinfo=None) == w})
        assert [c // 10**6 for c in got[k].candidates] == own
        assert ("dst_gap" in got[k].flags, "dst_ambiguous" in got[k].flags) == (not own, len(own) == 2)
        assert (got[k].lo, got[k].hi) == ((own[0] * 10**6, own[-1] * 10**6 + 10**6) if own else (None, None))


def test_decode_edges(spark):
    packed = lambda y, mo, d, h, mi, s: s | mi << 6 | h << 12 | d << 17 | mo << 22 | (y - 2000) << 26
    cases = [
        (packed(2024, 2, 29, 1, 2, 3), "dhav", "UTC", None, [], True),
        (packed(2023, 2, 29, 1, 2, 3), "dhav", "UTC", None, ["invalid_date"], False),
        (packed(2024, 2, 29, 1, 2, 3), "dhav", None, None, ["tz_unknown"], False),
        (2**31, "unix_s", None, "utc", ["epoch32_signed_overflow"], True),
        (2**32 - 1, "unix_s", None, "utc", ["epoch32_u32_wrap", "epoch32_signed_overflow", "implausible_date"], True),
        (2**32, "unix_s", None, "utc", ["epoch32_u32_wrap", "invalid_date"], False),
        (1704067200, "unix_s", "Europe/Berlin", None, ["tz_unknown"], False),
        (1704067200, "unix_s", "UTC", None, [], True),
        (1704067200_000001, "unix_us", None, "utc", [], True),
        (5, "else", "UTC", "utc", ["unsupported_format"], False),
        (10, "unix_s", None, "utc", ["implausible_date"], True),
        (None, "unix_s", "UTC", "utc", ["invalid_date"], False),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "id int, raw long, format string, zone string, basis string")
    got = {r.id: r for r in placement.decode(df, ["UTC", "Europe/Berlin", "No/Where"]).collect()}
    for k, (raw, kind, _, _, flags, placed) in enumerate(cases):
        assert (sorted(got[k].flags), got[k].lo is not None) == (sorted(flags), placed), cases[k]
        if placed:
            assert got[k].hi - got[k].lo == (1 if kind == "unix_us" else 10**6)
    assert placement.decode(df.where("false"), ["UTC"]).count() == 0


def test_start_and_end_by_name_or_value(spark):
    rows = [(1, 0, 50, "lastSec", "f"), (1, 1, 20, "firstSec", "f"), (1, 2, 10, "other", "f"), (2, 0, 7, "a", "f"), (2, 1, 3, "b", "f"), (2, 2, 9, "c", "g"), (3, 0, 4, "a", "f"), (4, 0, 4, "endSec", "f")]
    df = spark.createDataFrame([(*r, r[2], r[2] + 1, []) for r in rows], "clip int, pos int, raw long, field string, format string, lo long, hi long, flags array<string>")
    got = {r.clip: (r.first and r.first.raw, r.last and r.last.raw) for r in placement.start_and_end(df, ["clip"]).collect()}
    assert got == {1: (20, 50), 2: (3, 7), 3: (4, None), 4: (None, 4)}


def test_box_matches_against_the_loop(spark):
    found, truth = (x.collect() for x in matching_plans.boxes(spark, SMALL))
    by, due = {}, set()
    for t in truth:
        by.setdefault((t.image, t.class_name), {})[t.id] = t
    used = set()
    for f in sorted(found, key=lambda r: (-r.confidence, r.id)):
        best = []
        for t in by.get((f.image, f.class_name), {}).values():
            w, h = min(f.x2, t.x2) - max(f.x1, t.x1), min(f.y2, t.y2) - max(f.y1, t.y1)
            both = max(0, w) * max(0, h)
            if both / (800 - both) >= 0.5 and (t.image, t.class_name, t.id) not in used:
                best.append((both / (800 - both), t.id))  # of equal ones the later box
        if best and (f.image, f.class_name, "f", f.id) not in used:
            used |= {(f.image, f.class_name, max(best)[1]), (f.image, f.class_name, "f", f.id)}
            due.add((f.image, f.class_name, f.id, max(best)[1]))
    got = {(r.image, r.class_name, r.id, r.truth_id) for r in matching_plans.box_matches(spark, SMALL).collect()}
    assert got == due and len(due) > 20


def test_bootstrap_interval(spark):
    rows = {r.o_orderpriority: r for r in measuring_plans.bootstrap_rates(spark, SMALL).collect()}
    n = 1500 / len(rows)
    for r in rows.values():
        half = 1.96 * (r.rate * (1 - r.rate) / n) ** 0.5
        assert r.low < r.rate < r.high and 0.5 * half < (r.high - r.low) / 2 < 1.7 * half


def test_drift_and_correction(spark):
    rows = [(1, k * 3600 * 10**6, k * 3600 * 10**6 + 5 * 10**6 + k * 360000) for k in range(10)] + [(2, 10**9, 10**9 + 7 * 10**6)] + [(3, 0, 0), (3, 10**9, -(10**9))]
    df = spark.createDataFrame(rows, "k int, device_us long, true_us long")
    got = {r.k: r for r in measuring.drift_model(df, ["k"], 1.0).collect()}
    assert got[1].method == "linear" and got[1].offset_s == pytest.approx(5) and got[1].drift_ppm == pytest.approx(100) and got[1].usable and got[1].t == 2.306
    assert got[2].method == "offset_only" and got[2].half_s == 1.0 and got[2].warnings == ["single"]
    assert not got[3].usable and "non_monotonic" in got[3].warnings
    events = spark.createDataFrame([(1, 7200 * 10**6, 7201 * 10**6), (3, 5, 6)], "k int, lo long, hi long")
    out = {r.k: r for r in measuring.corrected(events, measuring.drift_model(df, ["k"], 1.0), ["k"]).collect()}
    assert out[3].corrected_lo is None
    middle = (out[1].corrected_lo + out[1].corrected_hi) / 2 / 1e6
    assert middle == pytest.approx(7200.5 + 5 + 0.72, abs=0.01) and out[1].corrected_lo < 7205.72 * 10**6 < out[1].corrected_hi


def test_scans_whatever_the_chunk(spark):
    own = random.Random(4)
    data = bytes(own.choice([0, 0, 0, 1, 0x67, 0x41]) for _ in range(3000)) + b"\0" * 9000 + b"ABABA" + b"\0\0\1"
    due = [(m.start() - (m.start() > 0 and data[m.start() - 1] == 0), m.start() + 3) for m in re.finditer(b"(?=\x00\x00\x01)", data) if m.start() + 3 < len(data)]
    for size in (1024, 4096, 1 << 20):
        df = images.chunked(spark.createDataFrame([("i", data), ("none", b"")], "img string, bytes binary"), size)
        assert sorted((r.at, r.payload) for r in bytestream.start_codes(df).collect()) == due
        counts = {r.signature: (r.n, r["first"]) for r in bytestream.signature_counts(bytestream.hits(df, {"aba": b"ABA", "zero": b"\0\0\0\0"}), size).collect()}
        zeros = [m.start() for m in re.finditer(b"(?=\x00{4})", data)]
        assert counts["aba"] == (2, [12000, 12002]) and counts["zero"] == (len(zeros), zeros[:20])
        linked = images.linked(df.select("img", "pos", "data"))
        assert sorted((r.at, r.payload) for r in bytestream.start_codes(linked).collect()) == due
    blocks = images.chunked(spark.createDataFrame([(1, b"\0" * 5000), (2, b"\0" * 4096 + b"x" + b"\0" * 4095 + b"\0" * 10)], "img int, bytes binary"), 8192)
    assert sorted(tuple(r) for r in bytestream.zero_runs(blocks).collect()) == [(1, 0, 5000), (2, 0, 4096), (2, 8192, 8202)]


def test_bytes_and_headers(spark):
    raw = bytes.fromhex("0102030405060708")
    row = spark.createDataFrame([(raw, b"\x00\x00\x03\x01\x00\x00\x03\x00", "Basis".encode("utf-16-le") + b"\0\0zz")], "d binary, e binary, n binary").select(bytestream.little_endian("d", 0, 4).alias("x"), bytestream.byte("d", 9).alias("none"), bytestream.unescaped("e").alias("u"), bytestream.gpt_name("n").alias("n"), bytestream.preview("d", 3).alias("p"), F.crc32("d").alias("c")).first()
    assert (row.x, row.none, bytes(row.u), row.n, tuple(row.p), row.c) == (0x04030201, None, b"\0\0\1\0\0\0", "Basis", ("010203", "..."), zlib.crc32(raw))
    g = spark.createDataFrame([(bytes(range(16)),)], "g binary").select(bytestream.guid("g")).first()[0]
    assert g == "03020100-0504-0706-0809-0a0b0c0d0e0f"
    import pandas as pd

    assert bytestream.printable(pd.Series([b"ab\0c", b"\x01", None, b""])).tolist() == ["ab", None, None, ""]


def test_chunk_digests(spark):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.img, r.pos): (r.size, r.sha256) for r in bytestreams.chunk_digests(spark, SMALL).collect()}
    due = {(k, p): (len(t[p : p + 512]), hashlib.sha256(t[p : p + 512]).hexdigest()) for k, t in texts.items() for p in range(0, len(t), 512)}
    assert got == due


def test_image_parts_from_files(spark, tmp_path):
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    for at in range(0, 5000, 1000):
        (tmp_path / f"disk.{at:012d}").write_bytes(data[at : at + 1000])
    rows = images.read_images(spark, str(tmp_path), 8).orderBy("pos").collect()
    assert b"".join(bytes(r.data) for r in rows) == data
    assert all(bytes(r.before) == data[max(0, r.pos - 8) : r.pos] and bytes(r.after) == data[r.pos + 1000 : r.pos + 1008] for r in rows)


def test_greedy_matches_of_many_images_in_few_calls(spark):
    """Images that several batches share, and no call of Python for each."""
    found = spark.range(900).selectExpr("id div 3 as image", "id", "id % 2 / 2.0D as confidence", "0.0D as x1", "0.0D as y1", "2.0D as x2", "2.0D as y2")
    truth = spark.range(600).selectExpr("id div 2 as image", "id", "0.0D as x1", "0.0D as y1", "2.0D as x2", "2.0D as y2")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = matching.greedy_matches(found, truth, ["image"])
        got = sorted((r.image, r.id, r.truth_id) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for image in range(300):
        ids = sorted(range(3 * image, 3 * image + 3), key=lambda k: (-(k % 2), k))
        want += [(image, ids[0], 2 * image + 1), (image, ids[1], 2 * image)]
    assert got == sorted(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_dependents_of_long_chains_and_circles(spark):
    jobs = [(k, k - 1) for k in range(1, 90)] + [(0, None), (200, 201), (201, 200), (300, 0)]
    df = spark.createDataFrame(jobs, "id long, parent long")
    got = {r.id: r.depth for r in records.dependents(df, F.col("id").isin(0, 200)).collect()}
    assert got == {k: k for k in range(90)} | {300: 1, 200: 0, 201: 1}


def test_dependents_beside_a_job_of_its_own(spark, monkeypatch):
    rounds = []
    real = pointers.chain_ends
    monkeypatch.setattr(pointers, "chain_ends", lambda links: rounds.append(real(links)) or rounds[-1])
    df = spark.range(2000).selectExpr("id", "id div 2 as parent")
    got = {r.id: r.depth for r in records.dependents(df, F.col("id") % 1000 == 7).collect()}
    want = {7: 0, 1007: 0}
    for k in range(8, 2000):
        if k not in want and k // 2 in want:
            want[k] = want[k // 2] + 1
    assert got == want and rounds[0][1] <= 6  # chains have 11 steps at most; 12 rounds before


def test_average_ranks_without_a_task_for_a_key(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(("a", "a", "b", None)), rng.choice((None, 0.5, 1.5, float(k)))) for k in range(200)]
    out = scoring.average_ranks(spark.createDataFrame(rows, "id long, k string, v double"), ["k"], "v", "r")
    least = lambda v: float("-inf") if v is None else v
    for r in out.collect():
        held = [least(v) for _, k, v in rows if k == r.k]
        assert r.r == 1 + sum(v < least(r.v) for v in held) + (held.count(least(r.v)) - 1) / 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 200 and "[k#" not in plan[plan.index("Window") :].split("\n")[0]


def test_links_by_edge_window(spark):
    s = spark.createDataFrame([("a", 1, "p", 0, 10), ("b", 2, "p", 500, 510), ("c", 1, "p", 600, 610), ("d", 3, "p", 515, 516)], "id string, camera long, class_name string, start long, end long")
    edges = spark.createDataFrame([(1, 2, None), (2, 3, 3), (1, 1, None)], "x long, y long, max_transit_us long")
    for width in (7, 100, 10**6):
        got = sorted((r.a, r.b, r.least) for r in timeline.link_candidates(s, edges, 490, width).collect())
        assert got == [("a", "b", 490), ("b", "c", 90)]


def test_links_deal_a_segment_once_for_an_edge(spark):
    rng = random.Random(8)
    rows = [(f"s{k}", rng.randrange(4), rng.choice("pq"), (at := rng.randrange(400)), at + rng.randrange(-30, 60)) for k in range(120)]  # some end before they begin
    edges = [(0, 1, None), (1, 0, 25), (2, 1, None), (3, 3, 9), (2, 3, 4)]
    s = spark.createDataFrame(rows, "id string, camera long, class_name string, start long, end long")
    e = spark.createDataFrame(edges, "x long, y long, max_transit_us long")
    windows = {(0, 1): 25, (1, 2): 10, (2, 3): 4}
    want = []
    for a, p, c, s0, e0 in rows:
        for b, q, d, s1, e1 in rows:
            least = max(0, s1 - e0, s0 - e1)
            if a < b and c == d and least <= windows.get((min(p, q), max(p, q)), -1):
                want.append((a, b, c, least, max(e1 - s0, e0 - s1)))
    for width in (7, 100, 10**6):
        assert sorted(map(tuple, timeline.link_candidates(s, e, 10, width).collect())) == sorted(want)
    left, right = timeline.link_sides(s, e, 10, 10**6)
    assert left.count() + right.count() == sum((p in w) for _, p, *_ in rows for w in windows)


def test_streams_as_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source = str(tmp_path / "in")
    e.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    for name, df in (("windows", live.windowed_counts(stream, "ts", ["event_type"], "1 day", "40 days")), ("keys", live.first_seen(stream, "ts", ["event_id"], "40 days"))):
        q = live.append_batches(df if name == "keys" else stream, str(tmp_path / name), str(tmp_path / f"c-{name}"), once=True)
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "keys")).count() == e.count()
    q = live.windowed_counts(stream, "ts", ["event_type"], "1 day", "40 days").writeStream.format("memory").queryName("day_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.d, r.event_type): r["count"] for r in e.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()}
    assert {(r.start.date(), r.event_type): r.n for r in spark.table("day_counts").collect()} == want


def against_duckdb(spark, folder, name):
    """(what Spark, what DuckDB returns) of a query over a folder of tables."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for at in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {at.stem} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).select(columns).collect()), sorted(found.fetchall())


def test_sentences_round_in_binary(spark, tmp_path):
    """28.5 / 100 lies just below 0.285, 57.5 / 100 just below 0.575, 12.5 / 100 is a half."""
    rows = spark.createDataFrame([(k, k, v) for k, v in enumerate((28.5, 57.5, 12.5, 28.51, 400.0))], "event_id long, user_id long, value double")
    rows.select("event_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value", F.lit("{}").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_duckdb(spark, tmp_path, "summary_sentences")
    assert got == want and got[0][1] == "click: 1 (max confidence 0.28)"


def test_scores_that_tie_in_binary(spark, tmp_path):
    """Two equal boxes (15295 ids apart) of scores 0.28 and 0.285, which is 0.28 in binary: the smaller id is kept."""
    rows = spark.createDataFrame([(0, 28.0), (15295, 28.5)], "event_id long, value double")
    rows.select("event_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), "value", F.lit("{}").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_duckdb(spark, tmp_path, "suppressed_boxes")
    assert got == want == [(1, "click", 0)]


def test_every_pair_of_boxes(spark, tmp_path):
    """Orders 7 and 507 lie in one image, 8 in another; boxes that don't overlap make a pair too."""
    rows = [(7, 1, 0, 0), (7, 2, 30, 5), (507, 1, 1, 1), (507, 3, 2, 0), (8, 1, 0, 0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got, want = against_duckdb(spark, tmp_path, "box_overlaps")
    assert got == want and len(got) == 6 and sum(r[3] == 0 for r in got) == 3
    ids = spark.range(100).select(F.lit(1).alias("k"), "id", *(F.col("id").cast("double").alias(c) for c in ("x1", "y1")), *((F.col("id") + 3.0).alias(c) for c in ("x2", "y2")))
    pairs = [(r.a, r.b) for r in matching.all_overlaps(ids, ["k"], 3).collect()]
    assert sorted(pairs) == [(a, b) for a in range(100) for b in range(a + 1, 100)]


def test_overlaps_are_rounded_without_decimals(spark):
    """As DuckDB rounds: 1.0000005 is just below its decimal in binary, 0.5 / 1e6 a half."""
    from spanloom.plans.matching import rounded

    values = [0.0, 5e-7, 1.0000005, 0.1428571428, 0.9999996, 2.0000015, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 6)).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchall()[0][0] for v in values]
    assert "round(" not in __spark_entry__.queries()["box_overlaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_merge_and_iou(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert [round(r[0], 6) for r in df.select(matching.iou("a", "b")).collect()] == [0.142857, 0.0]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert intervals.merge_spans(spark.createDataFrame([], "k int, s long, e long"), ["k"]).count() == 0


def test_spans_are_dealt_by_their_number(spark, monkeypatch):
    from spanloom.operators import along

    monkeypatch.setattr(along, "ROWS", 20)
    spans = spark.createDataFrame([(k % 50, k, k + 60) for k in range(400)], "img int, s long, e long")
    merged = intervals.merge_spans(spans, ["img"])
    assert merged.rdd.getNumPartitions() == 20  # not the session's 4, however many rows there are
    assert sorted(tuple(r) for r in merged.collect()) == [(k, k, k + 350 + 60) for k in range(50)]
