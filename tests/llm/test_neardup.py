"""Near duplicates against the comparison of all pairs, over whole tables and over one family just under the threshold."""

import collections
import random

import numpy as np
import pytest

from spanloom.llm import neardup


def word_sets(rows):
    """The contract's sets, without this library's hashes."""
    out = {}
    for doc_id, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
        for c in "\n\v\f\r":
            words = words.replace(c, " ")
        words = words.split(" ")
        words = [w for w in words if w]
        out[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def components(sets):
    """Smallest id reachable over links, all pairs that share a member compared exactly."""
    holders = collections.defaultdict(list)
    for k in sorted(sets):
        for x in sets[k]:
            holders[x].append(k)
    shared = collections.Counter((a, b) for own in holders.values() for i, b in enumerate(own) for a in own[:i])
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    n_links = 0
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            n_links += 1
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: root(k) for k in sets}, n_links


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = word_sets((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want, n_links = components(sets)
    got = neardup.near_duplicates(docs).collect()
    assert n_links > 100
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("most", [1000, 7])
def test_family_just_under_the_threshold(spark, monkeypatch, most):
    """Some hundred texts that are all nearly linked, a few that are: in one block, and dealt over many."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", most)
    r = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in r.sample(range(150), 5 if k % 6 else 3):
            words[at] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    want, _ = components(word_sets(rows))
    assert 3 < len(set(want.values())) < 119
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_block_judges_each_pair_once():
    r = np.random.default_rng(1)
    sets = [np.unique(np.concatenate((np.arange(100), r.integers(1000, 10**6, k % 50)))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(30)]
    sets = [np.sort(s) for s in sets]
    ids, comps = np.arange(30), np.arange(30) % 7
    block = neardup.Block(ids, comps, np.full(30, -1), neardup.sketch(sets), sets)
    got = block.links()
    fits = lambda a, b: 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b]))
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if comps[a] != comps[b] and fits(a, b)]
    linked = {(comps[a], comps[b]) for a, b in pairs if neardup.linked(sets[a], sets[b])}
    assert block.judged == len(pairs)
    assert {tuple(sorted((comps[a], comps[b]))) for a, b in got} == {tuple(sorted(x)) for x in linked}
    assert all(neardup.linked(sets[a], sets[b]) and comps[a] != comps[b] for a, b in got)
