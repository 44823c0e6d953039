"""Known answers of the operators, and every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanloom.operators import intervals, records, scoring, timeline
from spanloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merge_touching_nested_and_empty_spans(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 10, 20), (1, 12, 13), (1, 7, 7), (2, 5, 6)], "k int, s long, e long")
    merged = intervals.merge_spans(df, ["k"])
    assert rows(merged, "k", "s", "e") == [(1, 0, 6), (1, 10, 20), (2, 5, 6)]
    assert rows(intervals.merge_spans(merged, ["k"]), "k", "s", "e") == rows(merged, "k", "s", "e")
    sizes = spark.createDataFrame([(1, 15), (2, 6), (3, 9)], "k int, size long")
    assert rows(intervals.complement_spans(merged, sizes, ["k"]), "k", "s", "e") == [(1, 6, 10), (2, 0, 5), (3, 0, 9)]


def test_complement_keeps_an_image_without_a_name(spark, tmp_path):
    merged = spark.createDataFrame([(None, 2, 4), (None, 6, 9), (1, 0, 3)], "k int, s long, e long")
    sizes = spark.createDataFrame([(None, 12), (1, 5)], "k int, size long")
    assert {(r.k, r.s, r.e) for r in intervals.complement_spans(merged, sizes, ["k"]).collect()} == {(None, 0, 2), (None, 4, 6), (None, 9, 12), (1, 3, 5)}
    odd = "case when l_orderkey % 9 = 0 then null else l_suppkey end as l_suppkey, case when l_orderkey % 7 = 0 then -l_quantity - 0.5 else l_quantity end as l_quantity"
    duckdb.sql(f"copy (select * replace ({odd}) from '{SMALL}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalog.ORACLES["span_complement"]).fetchall()
    assert None in {r[0] for r in want}
    assert {tuple(r) for r in catalog.span_complement(spark, str(tmp_path)).collect()} == set(want)


def test_overlap_pairs_each_once_whatever_the_width(spark):
    df = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 50, 60), (1, 3, 60, 70), (1, 4, 99, 300), (1, 5, 5, 5)], "k int, id long, s long, e long")
    for width in (1, 7, 1000):
        assert rows(intervals.overlap_pairs(df, ["k"], width), "a", "b", "s", "e") == [(1, 2, 50, 60), (1, 3, 60, 70), (1, 4, 99, 100)]


def test_precedence_and_best_overlap(spark):
    df = spark.createDataFrame([(1, 0, 10, 2), (1, 5, 8, 0), (1, 10, 12, 2)], "k int, s long, e long, rank int")
    assert rows(intervals.label_by_precedence(df, ["k"]), "s", "e", "rank") == [(0, 5, 2), (5, 8, 0), (8, 12, 2)]
    left = spark.createDataFrame([(1, 1, 0, 10)], "k int, id long, s long, e long")
    right = spark.createDataFrame([(1, 7, 0, 4), (1, 8, 6, 10), (1, 9, 4, 5)], "k int, id long, s long, e long")
    assert rows(intervals.best_overlap(left, right, ["k"], 3), "l", "r", "overlap") == [(1, 7, 4)]


def test_localize_both_changes_of_summer_time(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-10-27 02:30:00'), (2, TIMESTAMP '2024-03-31 02:30:00'), (3, TIMESTAMP '2024-06-01 12:00:00') t(i, w)")
    got = {r.i: [str(x) for x in r.c] for r in df.select("i", F.transform(timeline.candidates(F.col("w"), "Europe/Berlin"), lambda c: c.cast("string")).alias("c")).collect()}
    assert got == {1: ["2024-10-27 00:30:00", "2024-10-27 01:30:00"], 2: [], 3: ["2024-06-01 10:00:00"]}


def test_sessions_gap_is_closed_and_null_instants_stay_out(spark):
    df = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 15, 16), (1, 3, 22, 23), (1, 4, None, None)], "k int, id long, lo long, end long")
    assert rows(timeline.sessions(df, ["k"], 5), "start", "end", "n") == [(0, 16, 2), (22, 23, 1)]


def test_daily_window_over_midnight(spark):
    hour = 3_600_000_000
    df = spark.createDataFrame([(1, 23 * hour, 23 * hour), (2, 26 * hour, 26 * hour + 5), (3, 12 * hour, 13 * hour)], "i int, lo long, hi long")
    got = dict(rows(df.withColumn("v", timeline.in_daily_window(F.col("lo"), F.col("hi"), 22 * hour, 2 * hour)), "i", "v"))
    assert got == {1: "within", 2: "overlaps_boundary", 3: None}


def test_no_such_comparison():
    with pytest.raises(ValueError):
        timeline.EventFilter(confidence=("~", 1.0)).predicate()


def test_wilson_and_empty(spark):
    low, high = scoring.wilson(F.col("k"), F.col("n"))
    df = spark.createDataFrame([(8.0, 10.0)], "k double, n double").select(F.round(low, 4), F.round(high, 4))
    assert tuple(df.first()) == (0.4902, 0.9433)


def test_rank_correlation_of_constant_and_short(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 1, 5), ("b", 2, 6), ("b", 2, 6), ("c", 1, 1)], "k string, x int, y int")
    assert rows(scoring.spearman(df, ["k"], "x", "y").withColumn("r", F.round("rho", 6)), "k", "r") == [("a", None), ("b", 1.0), ("c", None)]


def test_tampered_chain(spark):
    h = lambda p, x: spark.range(1).select(F.sha2(F.concat(F.lit(p), F.lit(x)), 256)).first()[0]
    a = h(records.GENESIS, "one")
    b = h(a, "two")
    log = [(1, 1, "one", records.GENESIS, a), (1, 2, "two!", a, b), (2, 1, "one", records.GENESIS, a), (2, 3, "two", a, b), (3, 1, "one", "x", a)]
    df = spark.createDataFrame(log, "k int, seq int, payload string, prev_hash string, entry_hash string")
    assert rows(records.chain_faults(df, ["k"]), "k", "seq", "fault") == [(1, 2, "content"), (2, 3, "sequence"), (3, 1, "content"), (3, 1, "previous")]


def test_link_reconcile_actions(spark):
    old = spark.createDataFrame([(1, "suggested"), (2, "confirmed"), (3, "suggested")], "k int, status string")
    new = spark.createDataFrame([(1,), (4,)], "k int")
    assert rows(timeline.reconcile(old, new, ["k"]), "k", "action") == [(1, "update"), (2, "keep"), (3, "delete"), (4, "insert")]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda r, names: tuple(str(round(r[names.index(c)], 6) + 0.0) if isinstance(r[names.index(c)], float) else str(r[names.index(c)]) for c in sorted(names))
    assert sorted(plain(tuple(r), df.columns) for r in df.collect()) == sorted(plain(r, columns) for r in found.fetchall())
