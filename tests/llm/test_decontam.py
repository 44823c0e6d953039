"""Regions of the q-gram filter against plain edit distance, and texts that repeat one gram."""

import random
import resource

from spanloom.llm import decontam


def distance(window, text):
    """Least edits of the window against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(window, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_each_window_within_its_budget_is_found():
    own = random.Random(6)
    letters = "abcdefgh "
    item = "".join(own.choice(letters) for _ in range(200))
    index = decontam.Index.build([(1, item)])
    for _ in range(40):
        at, edits = own.randrange(0, 120), own.randrange(0, 14)
        piece = list(item[at : at + 80])
        for _ in range(edits):
            k = own.randrange(len(piece))
            piece[k : k + 1] = own.choice(([], [own.choice(letters)], [piece[k], own.choice(letters)]))
        text = "".join(own.choice(letters) for _ in range(60)) + "".join(piece) + "".join(own.choice(letters) for _ in range(60))
        windows = ["".join(map(chr, w)) for w in index.windows]
        due = min(distance(w, text) - b for w, b in zip(windows, index.budgets.tolist()))
        got = index.passages([text])
        assert bool(got) == (due <= 0)
        if got:
            assert got[0][3] == min(d for w, b in zip(windows, index.budgets.tolist()) if (d := distance(w, text)) <= b)


def test_one_letter_a_hundred_thousand_times():
    index = decontam.Index.build([(1, "a" * 80), (2, "ab" * 60)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert {r[1] for r in index.passages(["a" * 100_000, "", "ab" * 30_000])} == {1, 2}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_frames_with_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and then it goes on for quite a while until the end of it"
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, f"x {text} y", 5), (3, f"x {text} y", 5), (None, text, 5), (4, "z" * 300_000, 5)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, text), (7, text), (8, None), (9, " ")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.find_passages(docs, bench).collect()) == [(0, 7), (3, 7)]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 4} and 3 not in {r.doc_id for r in kept.collect()}
    assert decontam.find_passages(docs.where("false"), bench).count() == decontam.find_passages(docs, bench.where("false")).count() == 0
