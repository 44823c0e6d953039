"""JPEGs written by hand, tokens of sections byte by byte, and the pipeline against a plain version of its stages."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spanloom.llm import bpe, decontam, media, neardup, pii, tokens, toxicity

SMALL = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

# ---- JPEGs


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


#: Twelve DC sizes in 4 bits each; four AC symbols in 3 bits each: end of block, sixteen zeros, and one value behind none or five zeros.
DC_BITS, AC_SYMBOLS = 4, [0x00, 0xF0, 0x01, 0x51]


def entropy(blocks, rng):
    """(bits) of blocks (difference of DC); AC values at random."""
    out = ""
    for diff in blocks:
        size = int(abs(diff)).bit_length()
        out += format(size, "04b") + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "")
        at = 1
        while at < 48 and rng.random() < 0.6:
            k = rng.choice([1, 2, 3])
            out += format(k, "03b") + (rng.choice("01") if k > 1 else "")
            at += (16, 1, 6)[k - 1]
        out += "000"
    out += "1" * (-len(out) % 8)
    return bytes(int(out[k : k + 8], 2) for k in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")


def jpeg(width, height, factors, restart=0, seed=1, scans=None, step=9):
    """A baseline JPEG of random grey blocks, and the thumbnail due. factors: (h, v) of each component."""
    rng = random.Random(seed)
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    wide, tall = -(-width // (8 * hm)), -(-height // (8 * vm))
    dc = [np.array([[rng.randrange(-100, 100) for _ in range(wide * h)] for _ in range(tall * v)]) for h, v in factors]
    body = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([step]) * 64)
    body += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors)))
    body += segment(0xC4, b"\0" + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))) + segment(0xC4, b"\x10" + bytes([0, 0, 4, *[0] * 13]) + bytes(AC_SYMBOLS))
    if restart:
        body += segment(0xDD, struct.pack(">H", restart))
    for scan in scans or [list(range(len(factors)))]:
        body += segment(0xDA, bytes([len(scan), *(x for k in scan for x in (k + 1, 0)), 0, 63, 0]))
        if len(scan) == 1:  # in one component's scan, blocks that hold some of the picture, row by row
            h, v = factors[scan[0]]
            w, t = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
            order = [[(scan[0], y, x)] for y in range(t) for x in range(w)]
        else:
            order = [[(k, y * factors[k][1] + j, x * factors[k][0] + i) for k in scan for j in range(factors[k][1]) for i in range(factors[k][0])] for y in range(tall) for x in range(wide)]
        pieces = [order[k : k + restart] for k in range(0, len(order), restart)] if restart else [order]
        for n, piece in enumerate(pieces):
            last, diffs = dict.fromkeys(scan, 0), []
            for mcu in piece:
                for k, y, x in mcu:
                    diffs.append(int(dc[k][y, x]) - last[k])
                    last[k] = int(dc[k][y, x])
            body += entropy(diffs, rng) + (bytes([0xFF, 0xD0 + n % 8]) if n + 1 < len(pieces) else b"")
    h, v = factors[0]
    own = dc[0][: -(-(-(-height * v // vm)) // 8), : -(-(-(-width * h // hm)) // 8)]
    return body + b"\xff\xd9", np.clip(np.rint(own * step / 8 + 128), 0, 255).astype(np.uint8)


def test_hand_made_jpegs(spark):
    made = [jpeg(40, 24, [(1, 1)]), jpeg(50, 33, [(1, 1)], restart=3), jpeg(64, 64, [(2, 2), (1, 1), (1, 1)]), jpeg(70, 41, [(2, 1), (1, 1), (1, 1)], restart=2), jpeg(37, 51, [(2, 2), (1, 1), (1, 1)], scans=[[0], [1], [2]]), jpeg(8, 8, [(1, 1)])]
    rows = [(k, m[0], "clash") for k, m in enumerate(made)] + [(90, None, ""), (91, b"", ""), (92, b"no picture", ""), (93, made[0][0][:60], ""), (94, made[2][0][: len(made[2][0]) // 2], "")]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary, error string")).collect()}
    for k, (_, due) in enumerate(made):
        r = got[k]
        assert r.error is None and (r.thumb_height, r.thumb_width) == due.shape, k
        assert bytes(r.thumbnail) == due.tobytes() and r.thumb_sha256 == hashlib.sha256(due.tobytes()).hexdigest() and len(r.average_hash) == 16
    assert (got[1].width, got[1].height) == (50, 33) and all(got[k].error for k in (90, 91, 92, 93))


def test_payload_columns(spark):
    texts = {1: None, 2: "", 3: "abc", 4: "é" * 500, 5: "x" * 300_000, 6: "abc"}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, media string")
    stored = {r.doc_id: bytes(r.media) for r in media.store_payloads(df).collect()}
    got = {r.doc_id: r for r in media.read_payloads(media.store_payloads(df)).collect()}
    for k, t in texts.items():
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[k].tail_crc32 == zlib.crc32(payload[-64:]) and got[k].media_bytes == len(stored[k]) and got[k].media_sha256 == hashlib.sha256(stored[k]).hexdigest()
    assert got[3].feature == got[6].feature and got[1].media_sha256 == got[2].media_sha256
    thumbs = {r.doc_id: r for r in media.read_media(media.store_payloads(df)).collect()}
    assert all(r.error is None and got[k].feature.endswith(r.thumb_sha256) for k, r in thumbs.items())


# ---- tokens


def test_tokens_byte_by_byte():
    rng = random.Random(7)
    for _ in range(500):
        lengths = np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 30))])
        total = int(lengths.sum())
        starts = np.array([0, *sorted(rng.sample(range(1, total), min(total - 1, rng.randint(0, 6))))])
        section = lambda byte: int(np.searchsorted(starts, byte, "right") - 1)  # noqa: E731, B023
        for rule in tokens.RULES:
            own, crossing, at = [0] * len(starts), [0] * len(starts), 0
            for n in lengths.tolist():
                held = [section(b) for b in range(at, at + n)]
                to = {"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]
                own[to] += 1
                crossing[to] += held[0] != held[-1]
                at += n
            got = tokens.allocate(lengths, starts, rule)
            assert [got[0].tolist(), got[1].tolist()] == [own, crossing]


def test_sections_of_texts(spark):
    texts = {1: None, 2: "", 3: "\n\nab\n", 4: "one line", 5: "é\nü " * 50, 6: "x" * 50_000}
    df = spark.createDataFrame([(k, t, 3, 4, 5) for k, t in texts.items()], "doc_id long, text string, section int, ids int, n_tokens int")
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(open(PATH, "rb").read()), special_tokens={})
    got = {}
    for r in tokens.section_tokens(df, PATH, PATTERN).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    for k, t in texts.items():
        rows = sorted(got[k])
        assert sum(r[3] for r in rows) == len(coder.encode_ordinary(t or "")) and [r[0] for r in rows] == list(range(len(rows)))
        assert "".join((t or "")[s:e] for _, s, e, _ in rows) == (t or "") and all((t or "")[s:e].endswith("\n") for _, s, e, _ in rows[:-1])
    assert {r.doc_id for r in bpe.encode(df, PATH, PATTERN).collect()} == set(texts)


# ---- pipeline


def plain_pipeline(spark):
    """The five stages one after another over Python lists; the classifier is the operator's own."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.classify(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    sets, root = [(k, set(neardup.shingle_set(t, {}).tolist())) for k, t in rows], {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    rows = [(k, t) for k, t in rows if find(k) == k]
    index = decontam.Index.build([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.text is not None])
    rows = [(k, t) for k, t in rows if not index.passages([t or ""])]
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(open(PATH, "rb").read()), special_tokens={})
    out = {}
    for k, t in rows:
        clean = pii.redact(t, pii.spans(t)[1]) if t else ""
        ids = coder.encode_ordinary(clean)
        out[k] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    return out


def test_pipeline_against_a_plain_one(spark):
    import corpus_pipeline

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == plain_pipeline(spark) and len(got) > 50


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"])
def test_stages_on_odd_rows(spark, name):
    """Nulls, empty texts, repeated rows and clashing columns: kept, with all columns, by every stage; an empty table stays empty."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", None, None, "x"), (3, "Some quite harmless words stand here.", None, "s", 37, "x"), (4, " \t", "en", "s", 2, None), (None, "an unnamed text", "en", "s", 15, "x")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    out = stage(spark, spark.createDataFrame(rows, kind), SMALL)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4]
    assert name == "encoding" or out.columns == [c.split()[0] for c in kind.split(", ")]
    assert stage(spark, spark.createDataFrame([], kind), SMALL).count() == 0
