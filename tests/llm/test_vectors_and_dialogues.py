"""Conversation repair, vector codes and similar vectors against plain versions, with odd rows."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from spanloom.llm import codes, covertree, dialogues

WHITE = " \t\n\v\f\r"
ANY = "conv_id long, turn long, role string, text string, cost string"


def every_repair(rows):
    """The least (cost, labels, messages) over all edits: every label for each row, up to two inserts at each place."""
    best = None
    options = []
    for role, text, gone, cut in rows:
        own = [("D", 2, None)]
        if not gone:
            own += [("K", 5 * cut, (role, text)), ("R", 1 + 5 * cut, ("user", text)), ("R", 1 + 5 * cut, ("assistant", text))]
        options.append(own)
    inserts = [list(p) for n in range(3) for p in itertools.product([("I", 5, ("user", "")), ("I", 5, ("assistant", ""))], repeat=n)]
    for picked in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            path = list(extra[0])
            for step, more in zip(picked, extra[1:]):
                path += [step, *more]
            said = [m for _, _, m in path if m]
            initials = "".join(m[0][:1] for m in said)
            rest = initials[1:] if initials.startswith("s") else initials
            if initials and (not rest or rest != "ua" * (len(rest) // 2)) or any(len(m[0]) == 0 for m in said):
                continue
            found = (sum(c for _, c, _ in path), "".join(x for x, _, _ in path), said)
            if best is None or found[:2] < best[:2]:
                best = found
    return best


def plain_report(rows):
    seen, faults, marked = set(), [0, 0, 0], []
    for role, text in rows:
        bare = text.strip(WHITE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        marked.append((role, text, fault in (0, 1), fault == 2))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, labels, said = every_repair(marked)
    return (*faults, illegal, cost, labels, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def test_repair_against_every_edit(spark):
    rng = random.Random(11)
    table, want = [], {}
    for conv in range(60):
        rows = []
        for turn in range(rng.randint(1, 3)):
            rows.append((turn, rng.choice(["user", "assistant", "system", "user", "tool", ""]), rng.choice(["Yes.", "No", "", " \t", "Why? ", "é!"])))
        if conv % 7 == 0 and len(rows) < 3:
            rows.append(rows[-1])
        table += [(conv, *r, "clash") for r in rows]
        want[conv] = plain_report([r[1:] for r in sorted(rows)])
    rng.shuffle(table)
    df = spark.createDataFrame(table, ANY)
    got = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256) for r in dialogues.repair_conversations(df).where("sha256 is not null").collect()}
    assert got == want


def test_repair_of_one_long_conversation(spark):
    """Cut by partitions, in chunks; equal to one pass over all rows; nulls and odd rows."""
    rng = random.Random(5)
    table = [(7, k, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["a.", f"{k}?", f"{k}.", f"{k}!", " ", f"{k}"]), None) for k in range(4000)]
    table += [(None, None, None, None, None), (None, 2, "user", "hm.", None), (8, None, "user", "q?", None), (8, None, "user", "q?", None), (9, -(1 << 62), "assistant", "z" * 200_000 + ".", None), (9, 1 << 62, "user", "", None)]
    whole = dialogues.Slice()
    seen = set()
    for _, _, role, text, _ in table[:4000]:
        whole.add(role, text, 1, not text.strip(WHITE), (role, text) in seen, text.rstrip(WHITE)[-1:] not in set(".!?"))
        seen.add((role, text))
    cost, labels = dialogues.best(dialogues.shortest(whole.rows, 0))
    m = dialogues.Messages(labels)
    for x in whole.texts:
        m.row(*x)
    m.inserted()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = dialogues.repair_conversations(spark.createDataFrame(table, ANY).repartition(5)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    own = sorted((r for r in rows if r.conv_id == 7), key=lambda r: r.chunk)
    assert len(own) > 1 and [r.sha256 for r in own[:-1]] == [None] * (len(own) - 1)
    assert (own[-1].cost, own[-1].audit, own[-1].sha256) == (cost, labels, m.digest.hexdigest())
    assert [x.asDict() for r in own for x in r.messages] == m.out
    by = {r.conv_id: r for r in rows if r.conv_id != 7}
    assert set(by) == {None, 8, 9} and by[8].duplicate == 1 and by[None].blank == 1
    assert dialogues.repair_conversations(spark.createDataFrame([], ANY)).count() == 0
    report = {r.conv_id: r for r in dialogues.repair_report(spark.createDataFrame(table, ANY)).collect()}
    assert set(report) == {7, None, 8, 9} and all(r.repaired_sha256 for r in report.values())
    assert dialogues.repair_report(spark.createDataFrame([], ANY)).count() == 0


def test_inserts_never_come_in_threes():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3, 1) for _ in range(rng.randint(0, 12))]
        cost, labels = dialogues.best(dialogues.shortest(rows, 0))
        assert "III" not in labels and cost <= 2 * len(rows)
        k = rng.randint(0, len(rows))
        both = dialogues.joined([dialogues.shortest(rows[:k], g) for g in dialogues.STATES], [dialogues.shortest(rows[k:], g) for g in dialogues.STATES])
        assert dialogues.best(both[0]) == (cost, labels)


def plain_codes(rows, rounds=codes.ROUNDS):
    rows = sorted((k, [int(np.floor(4096 * x)) for x in v], label) for k, v, label in rows)
    d = len(rows[0][1]) // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, v, _ in rows[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            held = [[] for _ in books[p]]
            for _, v, _ in rows:
                held[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out, per = [], {}
    for k, v, label in rows:
        found = [near(part(v, p), books[p]) for p in range(8)]
        out.append((k, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), label))
        per[label] = per.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(k, c, e, per[label], sha) for k, c, e, label in out]


@pytest.mark.parametrize("n", [1, 9, 300])
def test_codes(spark, n):
    rng = random.Random(n)
    good = [(k * 3 - 40, [rng.choice([0.0, rng.gauss(0, 1), -0.25]) for _ in range(16)], rng.choice([1, 2, None])) for k in range(n)]
    odd = [(-100, None, 1), (-99, [float("nan")] * 16, 1), (-98, [1.0] * 15 + [None], 2), (-97, [float("inf")] * 16, None), (-96, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in [*odd, *good]], "vec_id long, embedding array<double>, label int, codes string").repartition(3)
    assert sorted(tuple(r) for r in codes.code_report(df).collect()) == plain_codes(good)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.code_report(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0] * 5, 1), (2, [3e38] * 5, 1), (2, [3e38] * 5, 1), (3, [1.0] * 8, 1), (None, [2.0] * 5, None)]
    got = codes.code_report(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 2, 2] and all(len(r.code) == 16 for r in got)


def clustered(rng, width=16):
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=width)
            rows += [(len(rows) + k, (base + rng.normal(size=width) * rng.choice([0.05, 0.15, 0.3])).tolist(), label) for k in range(int(rng.integers(1, 30)))]
    return rows + [(len(rows) + k, rng.normal(size=width).tolist(), 1) for k in range(200)]


@pytest.mark.parametrize("cell", [60, 4096])
def test_similar_vectors(spark, cell):
    rows = clustered(np.random.default_rng(cell))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [1.0, None] * 8, 1), (n + 4, [float("nan")] * 16, 1), (n + 5, rows[0][1], 0), (n + 6, rows[0][1], 0), (n + 7, rows[0][1], 1), (n + 8, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<double>, label int, x double").repartition(4)
    got = sorted(tuple(r) for r in covertree.similar_vectors(df, cell=cell).collect())
    assert got == covertree.brute_force(rows) and any(r[1] for r in got)


def test_similar_vectors_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert covertree.similar_vectors(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [5.0, 0.0], 1)]
    got = covertree.similar_vectors(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0)]


def test_traversal_leaves_most_pairs_out():
    rng = np.random.default_rng(2)
    x = covertree.unit(np.repeat(rng.normal(size=(20, 8)), 100, 0) + 0.02 * rng.normal(size=(2000, 8)))
    one = np.ones(len(x), np.int64)
    p = covertree.Pairs(covertree.Tree(x), None, x, x, one, one, 0.93)
    assert (p.links[0] == ((x @ x.T) >= 0.93).sum(1) - 1).all() and p.seen < 2000 * 2000 / 20
