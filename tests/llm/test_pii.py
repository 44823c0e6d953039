"""Spans against the plain patterns, time on adversarial texts, and frames with odd rows."""

import random
import re
import time

from spanloom.llm import pii

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    twice = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if fits(k, m[0]))


def test_base_spans_are_the_plain_patterns():
    own = random.Random(8)
    bits = ["@", ".", "-", " ", "+", "a", "b.c", "1", "25", "255", "4111 1111 1111 1111", "4111-1111-1111-1111", "x@y.z", "+1 (555) 010-9999", "10.0.0.1", "é", "@@", "..", "\n", "(", "٣"]
    for _ in range(20_000):
        text = "".join(own.choice(bits) for _ in range(own.randint(0, 14)))
        assert pii.detect(text) == plain(text)
        base, both = pii.spans(text)
        assert base == plain(text) and set(base) <= set(both)


def test_disguises_map_back():
    for text, kind, part in (
        ("write to ann [at] site (dot) org now", 0, "ann [at] site (dot) org"),
        ("ann at site dot org dot uk!", 0, "ann at site dot org dot uk"),
        ("аnn@sitе.org", 0, "аnn@sitе.org"),
        ("call plus one five five five, zero one zero nine nine nine", 3, "plus one five five five, zero one zero nine nine nine"),
        ("at ten dot 10 dot 0 dot 0 dot 1 it", 1, "10 dot 0 dot 0 dot 1"),
    ):
        base, both = pii.spans(text)
        assert [(k, text[s:e]) for s, k, e in both if (s, k, e) not in base] == [(kind, part)]


def test_time_is_linear():
    texts = [" " * 1_000_000 + "[at]", "[ " * 300_000, "one " * 200_000 + "onex", "a@b.co ann [at] site.org " * 40_000, "plus " * 200_000, "+1(" * 200_000, "1" * 500_000, "a.b@" * 200_000]
    for t in texts:
        began = time.process_time()
        pii.spans(t)
        assert time.process_time() - began < 20
    base, both = pii.spans("a@b.co ann [at] site.org " * 100)
    assert len(base) == 100 and len(both) == 200


def test_frames_with_odd_rows(spark):
    rows = [(1, None, "k", 0), (2, "", "k", 0), (3, "ann@b.co", "k", 8), (3, "ann@b.co", "k", 8), (None, "x 10.0.0.1", "k", 10), (4, "long " * 50_000 + "ann [at] b.co", "k", 250_013)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")
    got = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.n_added, r.spans) for r in pii.find_pii(df).collect()))
    assert got == [(0, 0, 1, 0, "ip:2:10"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 0, 0, "email:0:8"), (3, 1, 0, 0, "email:0:8"), (4, 0, 0, 1, "email:250000:250013")]
    hidden = sorted((r.doc_id or 0, r.text, r.spans, r.n_chars) for r in pii.redact_pii(df.where("doc_id is null or doc_id > 1")).collect())
    assert [(k, t, n) for k, t, _, n in hidden[:4]] == [(0, "x [IP]", 6), (2, "", 0), (3, "[EMAIL]", 7), (3, "[EMAIL]", 7)] and hidden[4][1].endswith("long [EMAIL]")
    assert [r.text for r in pii.redact_pii(df.where("doc_id = 1")).collect()] == [None]
    assert pii.find_pii(df.where("false")).count() == pii.redact_pii(df.where("false")).count() == 0
