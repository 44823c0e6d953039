"""Stupid-backoff language-model scores of all documents against all others.

Documents are dealt into groups of bounded size. Each group is exploded into (gram, grp, n): one for each distinct
n-gram of orders 1 to ORDER that it holds, by a 64-bit hash that includes the order. A count table sums them by gram,
partitioned by hash, and is joined back to the groups; what comes back is summed per document: a word's score is
count(history + word) / count(history), or BACKOFF times the score with a history shorter by one word where that count
is 0, down to the word's share of all words, and 1 / (words + 1) for a word that occurs nowhere else. A document's own
n-grams are left out of the counts it is scored by; the logarithms add up to its score.

Most n-grams lie in one group only, which knows their counts itself. So a mark, some 36 first bits, of all
n-grams is sent beforehand, and only those that a second group may hold go on, whole and with their counts; n-grams
that agree in these bits by chance are sent for nothing. A group's n-grams are sent in order, a row for each bucket
(their first bits), so what comes back are bits and counts in that order, without the n-grams.

A bucket has a row of each group, with at most one entry for an n-gram however frequent it is. Defined results: a text
that is null or has no words scores 0 with 0 words; repeated rows count as often as they occur (rows equal in doc_id and
text lie in one group, all others are dealt by hash); an empty table gives no rows; texts are whole, however long; other
columns, however named, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, id_text, mix64, partitions_for, shared_table, word_hashes

ORDER, BACKOFF = 3, 0.4
#: Input file MB a group of documents has.
GROUP_MB = 6.0
#: First bits of an n-gram, by which it is dealt, for a group of full size (of smaller ones fewer, so that rows are as many as
#: the texts ask for), the least, and the next bits, by which those of several groups are told (whole bytes).
BUCKET_BITS, LEAST_BITS, MARK_BITS = 12, 4, 24


def hashed(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(words of each text, the text of each word, its place there, hashes of the n-grams that end with each word, by order).

    A word has n-grams of orders up to its place + 1; the other hashes mean nothing.
    """
    cache: dict[bytes, int] = {}
    words = [word_hashes((t or "").encode("utf-8", "surrogatepass"), cache) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [mix64(flat)]
    for n in range(2, order + 1):
        h = out[-1]
        out.append(mix64(np.concatenate((h[:0], h[:1] * np.uint64(0), h[:-1])) * np.uint64(0x9E3779B97F4A7C15) + flat + np.uint64(n)))
    return sizes, np.repeat(np.arange(len(words)), sizes), place, out


def distinct(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(the distinct n-grams of all orders, sorted, how often each occurs, words of all texts)."""
    sizes, _, place, hashes = hashed(texts, order)
    grams = np.sort(np.concatenate([h[place >= n] for n, h in enumerate(hashes)]))
    first = np.flatnonzero(np.concatenate((grams[:1] == grams[:1], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.append(first, len(grams))), int(sizes.sum())


def in_buckets(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, the first bits, that hold some of sorted n-grams, where each begins among them, and their end)."""
    bucket = grams >> np.uint64(64 - bits)
    first = np.flatnonzero(np.concatenate((bucket[:1] == bucket[:1], bucket[1:] != bucket[:-1])))
    return bucket[first].astype(np.int32), np.append(first, len(grams))


def last_bytes(x: np.ndarray, width: int, edges: np.ndarray) -> pa.Array:
    """The last `width` bytes of each number, a row for the numbers between two edges."""
    data = np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :])
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def numbers(rows: list[bytes], width: int) -> np.ndarray:
    """The numbers of last_bytes, of all rows."""
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, 8 - width :] = data
    return out.view(">u8")[:, 0].astype(np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Small numbers by bytes, all first ones first, so that they compress."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8")[:, 0].astype(np.int64)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of `bucket`, as tables in which no bucket is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column("bucket").to_numpy()
        if held and held[0].column("bucket")[0].as_py() != bucket[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut := int(np.searchsorted(bucket, bucket[-1])):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of keys, where among it each different one begins)."""
    order = np.argsort(keys)
    own = keys[order]
    return order, np.flatnonzero(np.concatenate((own[:1] == own[:1], own[1:] != own[:-1])))


def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, grp, words, held) with a bit for each n-gram of held: whether another one has the same mark."""
    for table in whole_buckets(batches):
        rows = table.column("held").to_pylist()
        sizes = np.array([len(r) * 8 // MARK_BITS for r in rows])
        order, first = alike(np.repeat(table.column("bucket").to_numpy().astype(np.uint64) << np.uint64(MARK_BITS), sizes) | numbers(rows, MARK_BITS // 8))
        runs = np.diff(np.append(first, len(order)))
        shared = np.zeros(len(order), bool)
        shared[order] = np.repeat(runs > 1, runs)
        at = np.cumsum(sizes) - sizes
        bits = [np.packbits(shared[s : s + n]).tobytes() for s, n in zip(at.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("bucket", "grp", "words")), pa.array(bits, pa.binary())], ["bucket", "grp", "words", "bits"])


def rest_bytes(bits: int) -> int:
    """Bytes that hold what of an n-gram isn't its bucket; their first bits may be the bucket's last ones."""
    return -(-(64 - bits) // 8)


def summed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, grp, bits, held, n) with the totals of held's n-grams over all groups."""
    width = rest_bytes(bits)
    for table in whole_buckets(batches):
        rows = table.column("held").to_pylist()
        sizes = np.array([len(r) // width for r in rows])
        counts = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32).astype(np.int64)
        order, first = alike(np.repeat(table.column("bucket").to_numpy().astype(np.uint64) << np.uint64(64 - bits), sizes) | numbers(rows, width))
        totals = np.zeros(len(order), np.int64)
        if len(order):
            totals[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(order))))
        at = np.cumsum(sizes) - sizes
        back = [planes(totals[s : s + n]) for s, n in zip(at.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("bucket", "grp", "bits")), pa.array(back, pa.binary())], ["bucket", "grp", "bits", "totals"])


def chosen(bits: pa.Table, edges: np.ndarray) -> np.ndarray:
    """Whether each n-gram of a group, whose buckets begin at edges, was sent: a group has a row of bits for each bucket."""
    rows = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(bits.column("bits").to_pylist(), np.diff(edges), strict=True)]
    return np.concatenate(rows).astype(bool) if rows else np.zeros(0, bool)


class Counted:
    """The n-grams of some texts: per order, each word's n-gram (that ends with it) and the distinct ones with their counts."""

    def __init__(self, texts: list[str | None], order: int):
        self.sizes, self.doc, self.place, hashes = hashed(texts, order)
        self.grams, self.distinct, self.number, self.counts = [], [], [], []
        for n, h in enumerate(hashes):
            at = np.flatnonzero(self.place >= n)
            keys, number, counts = np.unique(h[at], return_inverse=True, return_counts=True)
            whole = np.full(len(h), -1, np.int64)
            whole[at] = number
            self.distinct.append(keys)
            self.number.append(whole)
            self.counts.append(counts)

    def own(self, n: int) -> np.ndarray:
        """How often each word's n-gram (of order n + 1) occurs in its own text."""
        at = np.flatnonzero(self.number[n] >= 0)
        key = self.doc[at] * max(1, len(self.distinct[n])) + self.number[n][at]
        _, number, counts = np.unique(key, return_inverse=True, return_counts=True)
        out = np.zeros(len(self.doc), np.int64)
        out[at] = counts[number]
        return out


def score_texts(counted: Counted, total: list[np.ndarray], n_words: int, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores, words found nowhere else) of each text; total: corpus counts of counted.distinct, by order."""
    others = []  # of each word's n-gram, the count in other texts
    for n, t in enumerate(total):
        number = counted.number[n]
        others.append(np.where(number >= 0, t.astype(np.int64)[number] - counted.own(n), 0) if len(t) else np.zeros(len(number), np.int64))
    rest = n_words - counted.sizes[counted.doc]
    score = np.where(others[0] > 0, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1.0))
    for n in range(1, len(others)):
        history = np.concatenate((others[n - 1][:0], [1][: len(others[n - 1])], others[n - 1][:-1]))
        seen = others[n] > 0
        longer = np.log(np.maximum(others[n], 1)) - np.log(np.maximum(history, 1))
        score = np.where(seen, longer, score + np.where(counted.place >= n, np.log(backoff), 0))
    size = len(counted.sizes)
    return np.bincount(counted.doc, score, size).astype(np.float64), np.bincount(counted.doc, others[0] == 0, size).astype(np.int64)


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_unseen, log_score, mean_log_score) of each whole text."""
    bounded_batches(docs.sparkSession)
    groups = partitions_for(docs, GROUP_MB)
    first = min(BUCKET_BITS, max(LEAST_BITS, round(log2(partitions_for(docs, GROUP_MB / (1 << BUCKET_BITS)) / groups))))
    parts = min(groups, 1 << first)
    base = id_text(docs, id_col, text_col).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    dealt = lambda rows: rows.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def marks(key: tuple, table: pa.Table) -> pa.Table:
        grams, _, words = distinct(table.column("text").to_pylist(), order)
        buckets, edges = in_buckets(grams, first)
        own = np.zeros(len(buckets), np.int64)
        own[:1] = words  # a group's words are told once
        held = last_bytes(grams >> np.uint64(64 - first - MARK_BITS), MARK_BITS // 8, edges)
        return pa.Table.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), key[0].as_py(), np.int32)), pa.array(own), held], ["bucket", "grp", "words", "held"])

    def exploded(key: tuple, texts: pa.Table, bits: pa.Table) -> pa.Table:
        grams, counts, _ = distinct(texts.column("text").to_pylist(), order)
        buckets, edges = in_buckets(grams, first)
        bits = bits.sort_by("bucket")
        sent = chosen(bits, edges)
        edges = np.concatenate(([0], np.cumsum(sent)))[edges]
        held = last_bytes(grams[sent], rest_bytes(first), edges)
        own = counts[sent].astype(np.uint32)
        n = pa.array([own[s:e].tobytes() for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())
        return pa.Table.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), key[0].as_py(), np.int32)), bits.column("bits").combine_chunks(), held, n], ["bucket", "grp", "bits", "held", "n"])

    # what is shuffled for a table is deleted once it is written, so the steps never lie on disk together
    bits = shared_table(dealt(base.groupBy("grp").applyInArrow(marks, "bucket int, grp int, words long, held binary")).mapInArrow(several, "bucket int, grp int, words long, bits binary"))
    n_words = bits.agg(F.sum("words")).first()[0] or 0
    sent = base.groupBy("grp").cogroup(bits.select("bucket", "grp", "bits").groupBy("grp")).applyInArrow(exploded, "bucket int, grp int, bits binary, held binary, n binary")
    known = shared_table(dealt(sent).mapInArrow(lambda rows: summed(rows, first), "bucket int, grp int, bits binary, totals binary"))
    drop_table(bits)

    def scored(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        c = Counted(texts.column("text").to_pylist(), order)
        grams, total = np.concatenate(c.distinct), np.concatenate(c.counts)
        by, each = alike(grams)
        known = known.sort_by("bucket")
        if known.num_rows:
            found = np.add.reduceat(total[by], each)  # what no other group holds is counted in this one
            found[chosen(known, in_buckets(grams[by[each]], first)[1])] = np.concatenate([from_planes(x) for x in known.column("totals").to_pylist()])
            total[by] = np.repeat(found, np.diff(np.append(each, len(by))))
        total = np.split(total, np.cumsum([len(x) for x in c.distinct])[:-1])
        score, unseen = score_texts(c, total, n_words, backoff)
        mean = [s / n if n else 0.0 for s, n in zip(score.tolist(), c.sizes.tolist())]
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), pa.array(c.sizes), pa.array(unseen), pa.array(score), pa.array(mean)], ["doc_id", "n_words", "n_unseen", "log_score", "mean_log_score"])

    return base.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(scored, "doc_id long, n_words long, n_unseen long, log_score double, mean_log_score double")


#: The same scores for tables in which each doc_id occurs once, rounded to 6 places.
SQL = """
with words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos
  from (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents)
), grams as (
  select doc_id, pos, word as w1, lag(word) over d as w2, lag(word, 2) over d as w3 from words window d as (partition by doc_id order by pos)
), total as (select count(*) as n from words), sizes as (select doc_id, count(*) as n from words group by doc_id),
own1 as (select doc_id, w1, count(*) as n from grams group by all), all1 as (select w1, sum(n) as n from own1 group by all),
own2 as (select doc_id, w1, w2, count(*) as n from grams where w2 is not null group by all), all2 as (select w1, w2, sum(n) as n from own2 group by all),
own3 as (select doc_id, w1, w2, w3, count(*) as n from grams where w3 is not null group by all), all3 as (select w1, w2, w3, sum(n) as n from own3 group by all),
other1 as (select o.doc_id, o.w1, a.n - o.n as n from own1 o join all1 a using (w1)),
other2 as (select o.doc_id, o.w1, o.w2, a.n - o.n as n from own2 o join all2 a using (w1, w2)),
other3 as (select o.doc_id, o.w1, o.w2, o.w3, a.n - o.n as n from own3 o join all3 a using (w1, w2, w3)),
counted as (
  select g.doc_id, g.pos, t.n - s.n as rest, c1.n as c1, h1.n as h1, coalesce(c2.n, 0) as c2, h2.n as h2, coalesce(c3.n, 0) as c3
  from grams g cross join total t join sizes s using (doc_id) join other1 c1 using (doc_id, w1)
  left join other1 h1 on h1.doc_id = g.doc_id and h1.w1 = g.w2
  left join other2 c2 on c2.doc_id = g.doc_id and c2.w1 = g.w1 and c2.w2 = g.w2
  left join other2 h2 on h2.doc_id = g.doc_id and h2.w1 = g.w2 and h2.w2 = g.w3
  left join other3 c3 on c3.doc_id = g.doc_id and c3.w1 = g.w1 and c3.w2 = g.w2 and c3.w3 = g.w3
), scores as (
  select doc_id, c1, case
    when c3 > 0 then ln(c3) - ln(h2)
    when c2 > 0 then ln(c2) - ln(h1) + (case when pos > 2 then ln(0.4) else 0 end)
    else (case when c1 > 0 then ln(c1) - ln(greatest(rest, 1)) else -ln(rest + 1.0) end) + ln(0.4) * least(pos - 1, 2) end as score
  from counted
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_unseen, 0) as n_unseen, round(coalesce(log_score, 0), 6) as log_score, round(coalesce(log_score / n_words, 0), 6) as mean_log_score
from documents d left join (
  select doc_id, count(*) as n_words, cast(sum(cast(c1 = 0 as int)) as bigint) as n_unseen, sum(score) as log_score from scores group by doc_id
) using (doc_id)
"""
