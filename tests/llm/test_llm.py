"""The operators of spanloom.llm against brute force, round trips and held-out accuracy, on small fixtures with odd rows."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from spanloom.llm import bpe, chains, decontam, lm, media, neardup, pii, suffix, tokens, toxicity

SMALL = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
rng = random.Random(5)


def prose(n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


BASE, PASSAGE = prose(200), prose(70)
EDITED = " ".join("new" if k in (40, 120) else w for k, w in enumerate(BASE.split()))
TEXTS = [None, "", " \n\t", "one", "One", BASE, BASE, EDITED, prose(60) + " " + PASSAGE + " " + prose(60), PASSAGE + " " + prose(90), "ab" * 400, "x" * 350, "üñ¢ " * 120, prose(5000)]
ROWS = [(k, t, "clash", "clash") for k, t in enumerate(TEXTS)] + [(5, BASE, "clash", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, component_id string, n string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_near_duplicates(docs, empty):
    rows = neardup.near_duplicates(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    cache = {}
    sets = [(k, set(neardup.shingle_set(t, cache).tolist())) for k, t, *_ in ROWS]
    parent = {k: k for k, _ in sets}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {k: r.component_id for k, r in got.items()} == parent
    assert all(got[k].n_shingles == len(s) for k, s in sets) and got[7].component_id == 5
    assert neardup.near_duplicates(empty).count() == 0


def test_suffix_dedup(docs, empty):
    got = sorted(tuple(r) for r in suffix.digests(suffix.deduplicate(docs)).collect())
    assert got == sorted(suffix.brute_force([(k, t) for k, t, *_ in ROWS]))
    assert suffix.deduplicate(empty).count() == 0


def test_collection_order():
    words = [b"banana", b"ananas", b"", b"nab"]
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        doc, left, lcp = suffix.Collection(words, folder).build()
    found = [words[d][len(words[d]) - n :] for d, n in zip(doc, left)]
    assert found == sorted(found)
    for a, b, n in zip(found, found[1:], lcp[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_round_of_a_collection_writes_one_file(tmp_path):
    local = random.Random(6)
    words = [bytes(local.choice(b"ab\xf4") for _ in range(local.randrange(40))) for _ in range(30)]
    doc, left, lcp = suffix.Collection(words, str(tmp_path)).build()
    assert len(list(tmp_path.iterdir())) == 2  # one that is read, one that is written
    got = [words[d][len(words[d]) - n :] for d, n in zip(doc.tolist(), left.tolist())]
    assert got == sorted(got) and len(got) == sum(map(len, words)) + len(words)
    common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(got, got[1:])]
    assert lcp[1:].tolist() == common


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, empty, order):
    """Against a plain count of all n-grams, repeated rows (doc_id 5) counting twice."""
    words = [(k, (t or "").encode().lower().split()) for k, t, *_ in ROWS]
    grams = lambda w: collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    whole = collections.Counter()
    for _, w in words:
        whole.update(grams(w))
    total, due = sum(len(w) for _, w in words), []
    for k, w in words:
        own, score = grams(w), 0.0
        other = lambda g: whole[g] - own[g]  # noqa: E731, B023
        for i in range(len(w)):
            n, price = min(order, i + 1), 0.0
            while n > 1 and not other(tuple(w[i - n + 1 : i + 1])):
                n, price = n - 1, price + math.log(lm.BACKOFF)
            count, rest = other(tuple(w[i - n + 1 : i + 1])), total - len(w)
            if n > 1:
                score += price + math.log(count / other(tuple(w[i - n + 1 : i])))
            else:
                score += price + (math.log(count / rest) if count else -math.log(rest + 1))
        due.append((k, len(w), round(score, 6)))
    assert sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm.lm_scores(docs, order).collect()) == sorted(due)
    assert lm.lm_scores(empty, order).count() == 0


def test_only_shared_ngrams_are_sent_whole(spark, monkeypatch):
    """Of words that one group holds alone only the first bits go; whatever comes of these bits, scores are the same."""
    sent, write = [], lm.shared_table
    monkeypatch.setattr(lm, "shared_table", lambda df: sent.append(write(df)) or sent[-1])
    monkeypatch.setattr(lm, "drop_table", lambda df: None)
    rows = [(k, " ".join(f"w{(k * 50 + i) % 900 if i < 10 else k * 1000 + i}" for i in range(60))) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.lm_scores(table).count() == 40
    held = sum(len(lm.distinct([t], 3)[0]) for _, t in rows)
    back = sum(len(lm.from_planes(r.totals)) for r in sent[1].collect())
    assert sent[1].columns == ["bucket", "grp", "bits", "totals"] and 0 < back < held / 4


@pytest.mark.parametrize("first", [4, 9, 12])
def test_ngrams_that_agree_in_their_first_bits_by_chance(first):
    """Groups 0 and 1 share 7 << 60; 5 << 45 of the one and (5 << 45) + 1 of the other have the same mark, but their own totals."""
    groups = [np.array([5 << 45, 6 << 45, 7 << 60], np.uint64), np.array([(5 << 45) + 1, 7 << 60], np.uint64)]
    counts, found, shift = [np.array([2, 1, 3]), np.array([4, 5])], [], np.uint64(64 - first - lm.MARK_BITS)
    for step in ("several", "summed"):
        rows = []
        for k, grams in enumerate(groups):
            buckets, edges = lm.in_buckets(grams, first)
            sent = np.concatenate([b for g, _, b in sorted(found, key=lambda r: r[1]) if g == k]) if found else np.ones(len(grams), bool)
            cut = np.concatenate(([0], np.cumsum(sent)))[edges]
            data = lm.last_bytes(grams >> shift, lm.MARK_BITS // 8, edges) if step == "several" else lm.last_bytes(grams[sent], lm.rest_bytes(first), cut)
            n = [counts[k][sent][s:e].astype(np.uint32).tobytes() for s, e in zip(cut[:-1], cut[1:])]
            rows += [{"bucket": int(b), "grp": k, "words": 0, "bits": b"", "held": h, "n": c} for b, h, c in zip(buckets, data.to_pylist(), n)]
        table = pa.Table.from_pylist(sorted(rows, key=lambda r: r["bucket"]), pa.schema({"bucket": pa.int32(), "grp": pa.int32(), "words": pa.int64(), "bits": pa.binary(), "held": pa.binary(), "n": pa.binary()}))
        out = [r for b in (lm.several if step == "several" else lambda rows: lm.summed(rows, first))(table.to_batches(max_chunksize=1)) for r in b.to_pylist()]
        if step == "several":
            length = {(k, int(b)): n for k, g in enumerate(groups) for b, n in zip(lm.in_buckets(g, first)[0], np.diff(lm.in_buckets(g, first)[1]))}
            found = [(r["grp"], r["bucket"], np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=length[r["grp"], r["bucket"]]).astype(bool)) for r in out]
            assert [b.tolist() for _, _, b in found] == [[True, False], [True], [True], [True]]
    assert [(r["grp"], lm.from_planes(r["totals"]).tolist()) for r in out] == [(0, [2]), (1, [4]), (0, [8]), (1, [8])]


def test_decontamination(spark, empty):
    item = prose(30)
    edited = item[:50] + "x" + item[52:]
    rows = [(1, prose(50) + " " + item.upper() + " " + prose(10)), (2, edited), (3, prose(90)), (4, None), (5, ""), (6, item[: len(item) // 3])]
    bench = spark.createDataFrame([(9, item), (8, None), (7, "short"), (9, item)], "item_id long, text string")
    found = decontam.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 9), (2, 9)]
    assert decontam.find_passages(empty, bench).count() == 0
    assert decontam.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_decontamination_at_each_offset(spark):
    own = random.Random(4)
    text = lambda n: "".join(own.choice("abcdefghijklmnop ") for _ in range(n))
    item, around = text(300), [text(150).upper().translate({32: "_"}) for _ in range(2)]
    size = decontam.WINDOW - decontam.STEP
    rows = [(k, f"{around[0]}QQQ{item[k : k + size]}QQQ{around[1]}") for k in range(len(item) - size + 1)]
    rows += [(1000, "Is the answer 42\tor 43?"), (1001, "is the answer 41 or 43"), (1002, "42"), (1003, "")]
    bench = spark.createDataFrame([(1, item), (2, "answer 42 OR"), (3, "42"), (4, " "), (5, ""), (6, "is the answer 41 or 43"), (7, "42")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in decontam.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {k for k, item_id in found if item_id == 1} == set(range(len(item) - size + 1))
    assert {k: v for k, v in found.items() if k[1] > 1} == {(1000, 2): (0, 7, 19), (1000, 3): (0, 14, 16), (1000, 7): (0, 14, 16), (1001, 6): (0, 0, 22), (1002, 3): (0, 0, 2), (1002, 7): (0, 0, 2)}


def test_passages(docs, empty):
    got = {(r.doc_id, r.pivot_id): r for r in chains.fuzzy_passages(docs).collect()}
    assert {(6, 5), (7, 5), (9, 8)} <= set(got)
    assert (got[9, 8].start, got[9, 8].end, got[9, 8].pivot_start, got[9, 8].pivot_end) == (0, 70, 60, 130)
    assert 13 not in {k for pair in got for k in pair}
    assert chains.fuzzy_passages(empty).count() == 0


def test_passages_whose_seeds_occur_earlier(spark):
    """Each seed of the passage occurs singly in an earlier document; document 0 also holds the first part of it."""
    own = random.Random(9)
    words = lambda n: " ".join("".join(own.choice("bcdfghkmpw") for _ in range(7)) for _ in range(n))
    passage = words(70)
    whole = [f"{words(40)} {passage} {words(40)}" for _ in range(2)]
    early = [" ".join(whole[0].split()[k : k + chains.SEED]) for k in range(40, 110 - chains.SEED + 1)]
    found = lambda texts: {(r.doc_id, r.pivot_id): (r.start, r.end) for r in chains.fuzzy_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = len(early)
    assert found([*early, *whole]) == {(n + 1, n): (40, 110)}
    half = f"{words(40)} {' '.join(passage.split()[:35])} {words(40)}"
    assert found([half, *early, *whole])[n + 2, n + 1] == (40, 110)


def test_chain_against_all_predecessors():
    for _ in range(20):
        matches = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(25)})
        paths = chains.chain(matches)
        assert sorted(m for p in paths for m in p) == matches
        assert all(a[0] < b[0] and a[1] < b[1] for p in paths for a, b in zip(p, p[1:]))


def test_chain_scores_against_all_predecessors():
    price = chains.GAP / chains.SEED / 2
    own = random.Random(3)
    for size in (40, 300, 1000):
        for _ in range(20):
            matches = sorted({(own.randint(0, size), own.randint(0, size)) for _ in range(60)} | {(k, k) for k in range(0, size, 9) if k % 150 < 60})
            score = {}
            for x, y in matches:
                near = [s - price * (x - p + y - q) for (p, q), s in score.items() if p < x and q < y and max(x - p, y - q) <= chains.REACH]
                score[x, y] = 1 + max([0.0, *near])
            best = chains.chain(matches)[0]
            got = len(best) - sum(price * (c - a + d - b) for (a, b), (c, d) in zip(best, best[1:]))
            assert got == pytest.approx(max(score.values())) and all(max(c - a, d - b) <= chains.REACH for (a, b), (c, d) in zip(best, best[1:]))
    first, second = [(5 * k, 5 * k) for k in range(10)], [(150 + 5 * k, 150 + 5 * k) for k in range(5)]
    assert chains.chain(first + second) == [first, second]


def test_passage_with_an_inserted_word():
    words = chains.word_hashes(prose(50).encode(), {})
    other = chains.np.insert(words, 25, 7)
    assert chains.shared_passages(words, other, [(2, 2)]) == [(0, 50, 0, 51, 50, 1)]


def test_bpe_is_the_librarys(docs, empty):
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(open(PATH, "rb").read()), special_tokens={})
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(docs, PATH, PATTERN).collect())
    due = sorted((k, b"".join(i.to_bytes(4, "little") for i in coder.encode_ordinary(t or ""))) for k, t, *_ in ROWS)
    assert [(k, bytes(v)) for k, v in got] == due
    decoded = {r.doc_id: r.decoded_sha256 for r in bpe.decode_digests(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    assert decoded == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t, *_ in ROWS}
    assert bpe.encode(empty, PATH, PATTERN).count() == 0


def test_bpe_append_and_edit():
    text = bpe.TextCoder(bpe.read_ranks(open(PATH, "rb").read()), PATTERN)
    a, b = "Some words, 1234 and more", " of them here's"
    assert text.append(a, text.encode(a), b) == text.encode(a + b)
    data = b"internationalisation"
    table = text.coder.extend(data, [])
    edited, new = text.coder.edit(data, table, 5, 7, b"xyz")
    assert edited == b"interxyztionalisation" and new == text.coder.extend(edited, [])


def test_tokens_of_sections_add_up(docs, empty):
    total = {r.doc_id: r.n_tokens for r in bpe.encode(docs, PATH, PATTERN).collect()}
    for rule in tokens.RULES:
        got = collections.Counter()
        for r in tokens.section_tokens(docs, PATH, PATTERN, " ", rule).collect():
            got[r.doc_id] += r.n_tokens
        assert {k: got[k] for k in total if k != 5} == {k: n for k, n in total.items() if k != 5} and got[5] == 2 * total[5]
    assert tokens.section_tokens(empty, PATH, PATTERN).count() == 0


def test_pii():
    base, all_spans = pii.spans("mail a.b@c.org or jo [at] host [dot] com, 10.0.0.1, 4111 1111 1111 1111, +1 (555) 123-4567")
    assert pii.listed(base) == "email:5:14,ip:42:50,card:52:71,phone:73:90"
    assert set(base) < set(all_spans) and (18, 0, 40) in all_spans
    assert pii.spans("") == ([], [])
    assert pii.detect("999.1.1.1 4111 1111 1111 1112") == []


def test_media_round_trip(docs, empty):
    got = {r.doc_id: r for r in media.read_payloads(media.store_payloads(docs)).collect()}
    for k, t, *_ in ROWS:
        payload = media.pad_payload((t or "").encode())
        assert got[k].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[k].payload_bytes == len(payload) and len(payload) % 64 == 0 < len(payload)
    assert media.read_payloads(media.store_payloads(empty)).count() == 0


def test_toxicity_held_out(spark, empty):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in scored if r.toxic], [r for r in scored if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(0 <= r.score <= 1 for r in scored)
    assert toxicity.classify(empty, labels.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    ids = {r.doc_id for r in out.collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < len(ids) <= docs.count()
    bad = {r.doc_id for r in decontam.find_passages(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert not ids & bad
