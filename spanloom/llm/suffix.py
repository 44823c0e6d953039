"""Removal of repeated byte strings by column-wise construction of a multi-document suffix order.

A byte is removed when a LENGTH-byte string covers it that also starts earlier: in a document of smaller doc_id, or
earlier in the same one. Strings are judged on the input.

1. Each text is cut into pieces: runs of LENGTH-byte strings with the same least hashed K-byte substring (minimizer).
   Equal strings have equal minimizers, so they meet in pieces of one minimizer.
2. Pieces meet by minimizer. Those whose minimizer occurs once are done; of equal pieces all but the first are removed
   (a map task sends a piece that it has sent before no more than it must, so a frequent one fills no partition).
3. What differs but shares a minimizer goes to one partition, whose pieces are the documents of a collection. `Collection`
   inserts one symbol per document each round, from the last to the first, and keeps the collection's Burrows-Wheeler
   transform, common prefixes and suffix names as rows of one word in a file that a round reads and writes in sequence.
   Neighbours in the final order with LENGTH common bytes are occurrences of one string; all but the first are removed.

Collections hold at most COLLECTION bytes or one minimizer's different pieces. Defined results: a null text is empty,
an empty text loses nothing; rows that share a doc_id are occurrences of one document (equal rows keep equal parts);
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, mix64, shared_table

LENGTH, K = 100, 24
#: A piece's strings at most, as they share a minimizer.
MOST = LENGTH - K + 1
COLLECTION = 200_000
#: Stands for a doc_id that is null, so that joins need no filter and deal the texts out once.
NO_ID = -(1 << 63)
#: Bits of a place within a batch; the other bits of a word order its K-byte substrings.
_PLACE = np.uint64(30)
#: Pieces that a map task remembers, so that it sends a frequent one once.
REMEMBERED = 400_000
#: Bytes of text cut at a time.
CHUNK = 1 << 19


def _cut(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(d) for d in datas], np.int64)
    joined = b"".join(datas)
    none = np.zeros(0, np.int64)
    begins = np.cumsum(sizes) - sizes
    start = np.concatenate([np.arange(b, b + s - LENGTH + 1) for b, s in zip(begins.tolist(), sizes.tolist()) if s >= LENGTH] or [none])
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    n = len(joined) - K + 1
    word = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,)).copy()
    h = mix64(word[:n] * np.uint64(0x9E3779B97F4A7C15) + word[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + word[16 : n + 16] * np.uint64(0x165667B19E3779F9))
    least, have = (h >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64), 1  # of equals the leftmost
    while have < MOST:
        step = min(have, MOST - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    key = (least[start] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    head = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    doc = np.searchsorted(begins, first, "right") - 1
    return doc, first - begins[doc], count, h[key[head]]


def pieces(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, start, strings, minimizer) of each piece of each document, all documents of up to 1 GB."""
    parts, at = [], 0
    while at < len(datas):
        stop, size = at + 1, len(datas[at])
        while stop < len(datas) and size + len(datas[stop]) <= CHUNK:
            size += len(datas[stop])
            stop += 1
        doc, *rest = _cut(datas[at:stop])
        parts.append((doc + at, *rest))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else _cut([])


class SequentialFile:
    """An array on disk, in two mapped files: a round reads one from front to back and writes the other."""

    def __init__(self, folder: str, name: str, kind: type, capacity: int):
        self.maps = [np.memmap(os.path.join(folder, f"{name}{k}"), kind, "w+", shape=(max(1, capacity),)) for k in (0, 1)]
        self.size = 0

    def next(self, size: int) -> np.ndarray:
        """The other file, to be written: what is read from then on."""
        self.maps.reverse()
        self.size = size
        return np.asarray(self.maps[0][:size])

    def read(self) -> np.ndarray:
        return np.asarray(self.maps[0][: self.size])


#: A suffix as a row of one word: the symbol before it, the common prefix with the one before, its bytes, its document.
ROW = np.dtype([("symbol", "u1"), ("prefix", "u1"), ("left", "u1"), ("pad", "u1"), ("doc", "<i4")])


class Collection:
    """Suffix order of many short documents, built by columns.

    After round r the file describes all suffixes of at most r bytes in order: the symbol before each (0 where its
    document begins), the common prefix with the one before it, and which document's suffix of what length it is.
    """

    def __init__(self, documents: list[bytes], folder: str):
        self.sizes = np.array([len(d) for d in documents], np.int64)
        self.symbols = np.frombuffer(b"".join(documents), np.uint8)
        self.ends = np.cumsum(self.sizes)
        count = len(documents)
        self.rows = SequentialFile(folder, "rows", np.int64, count + len(self.symbols))
        self.rows.next(count)[:] = self._made(np.arange(count), 0)

    def _made(self, docs: np.ndarray, length: int) -> np.ndarray:
        """Rows of the documents' suffixes of `length` bytes; symbols count from 1 (UTF-8 has no byte 255), 0 where the document begins."""
        made = np.zeros(len(docs), ROW)
        at = self.ends[docs] - length - 1
        more = self.sizes[docs] > length
        made["symbol"][more] = self.symbols[at[more]] + np.uint8(1)
        made["left"], made["doc"] = length, docs
        return made.view(np.int64)

    def insert_column(self, length: int) -> None:
        """Insert each document's suffix of `length` bytes."""
        rows = self.rows.read()
        fields = rows.view(ROW)
        bwt, lcp = np.ascontiguousarray(fields["symbol"]), np.append(fields["prefix"], np.uint8(0))
        count = len(self.sizes)
        order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]  # rows by the symbol before them: the order of the longer suffixes
        new = (fields["left"] == length - 1)[order]
        fresh = np.flatnonzero(new)
        near = new.copy()
        near[1:] |= new[:-1]
        ask = np.flatnonzero(near)  # new suffixes and the ones after them
        ask_prefix = np.zeros(len(ask), np.uint8)
        of, before = order[ask], order[ask - 1]
        same = np.flatnonzero((bwt[of] == bwt[before]) & (ask > 0))
        low, high = before[same] + 1, of[same] + 1
        by = np.argsort(-low)
        bounds = np.stack((low[by], high[by]), 1).reshape(-1)
        if len(bounds):
            ask_prefix[same[by]] = np.minimum(np.minimum.reduceat(lcp, bounds)[::2], 254) + 1
        added = self._made(fields["doc"][order[fresh]], length)
        out = self.rows.next(count + len(order))
        out[:count] = rows[:count]
        body = out[count:]
        body[~new] = rows[count:]
        body[fresh] = added
        body.view(ROW)["prefix"][ask] = ask_prefix

    def build(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, suffix length, common prefix with the one before) in suffix order."""
        for length in range(1, int(self.sizes.max(initial=0)) + 1):
            self.insert_column(length)
        rows = self.rows.read().view(ROW)
        return rows["doc"].copy(), rows["left"].astype(np.int64), rows["prefix"].copy()


def later_strings(documents: list[bytes], doc_ids: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document number, offset) of each `length`-byte string that also starts earlier, by (doc_id, start + offset)."""
    with tempfile.TemporaryDirectory(prefix="collection-") as folder:
        collection = Collection(documents, folder)
        doc, left, lcp = collection.build()
    keep = np.flatnonzero(left >= length)  # a shorter suffix never stands between equal strings
    doc, offset = doc[keep], collection.sizes[doc[keep]] - left[keep]
    group = np.cumsum(lcp[keep] < length)
    order = np.lexsort((starts[doc] + offset, doc_ids[doc], group))
    doc, offset, group = doc[order], offset[order], group[order]
    head = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, np.arange(len(group)), 0))
    later = (doc_ids[doc] != doc_ids[doc[head]]) | (starts[doc] + offset != starts[doc[head]] + offset[head])
    return doc[later], offset[later]


# ---- DataFrames ------------------------------------------------------------------------------------------------------


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


PIECES = "key long, content long, doc_id long, place long, known boolean"


def piece_rows(own: DataFrame) -> DataFrame:
    """(key, content hash, doc_id, place: start * 256 + strings, known) of each piece.

    key is the minimizer. A piece of which the task has seen an earlier copy is `known` as one, and dealt by doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[int, tuple[int, int]] = {}
        for b in batches:
            datas = [_bytes(t) for t in b.column("text").to_pylist()]
            ids = b.column("doc_id").to_numpy()
            doc, start, count, minimizer = pieces(datas)
            content = [xxhash.xxh3_64_intdigest(datas[d][s : s + c + LENGTH - 1]) for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist())]
            doc_id, place = ids[doc], start << 8 | count
            known = np.zeros(len(doc), bool)
            for k, (c, at) in enumerate(zip(content, zip(doc_id.tolist(), place.tolist()))):
                before = earliest.setdefault(c, at)
                if before < at:
                    known[k] = True
                elif before > at:
                    earliest[c] = at
            if len(earliest) > REMEMBERED:
                earliest.clear()
            key = np.where(known, mix64(doc_id.astype(np.uint64)), minimizer)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(doc_id), pa.array(place), pa.array(known)], [x.split()[0] for x in PIECES.split(", ")])

    return own.mapInArrow(run, PIECES)


def repeated_pieces(rows: DataFrame) -> DataFrame:
    """(key, doc_id, place, copy): copies of pieces but the first of each, and the first ones of pieces that differ but share a key.

    Rows come sorted by key, content and place; a task holds no more than the row before and one first piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int] | None = None  # key, content, doc_id and place of the first row of the run that goes on
        lone = False  # whether that is its key's only first piece, not given out so far
        for b in batches:
            known = b.column("known").to_numpy(zero_copy_only=False)
            given = [b.column(c).to_numpy() for c in ("key", "content", "doc_id", "place")]
            out = [[given[0][known], given[2][known], given[3][known], np.ones(int(known.sum()), bool)]]
            if not known.all():
                key, content, doc_id, place = (a[~known] if last is None else np.append(x, a[~known]) for a, x in zip(given, last or [0] * 4))
                head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1]))))  # first copies
                of = np.repeat(head, np.diff(np.append(head, len(key))))
                copy = (doc_id != doc_id[of]) | (place != place[of])  # a repeated row is no copy
                same = np.concatenate(([False], key[head][1:] == key[head][:-1], [False]))
                several = same[1:] | same[:-1]
                give = several.copy()
                give[0] &= last is None or lone
                lone = not several[-1] and (last is None or len(head) > 1 or lone)
                last = [a[head[-1]] for a in (key, content, doc_id, place)]
                for at, is_copy in ((np.flatnonzero(copy), True), (head[give], False)):
                    out.append([key[at], doc_id[at], place[at], np.full(len(at), is_copy)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "doc_id", "place", "copy"])

    dealt = rows.repartition("key").sortWithinPartitions("known", "key", "content", "doc_id", "place")
    return dealt.mapInArrow(run, "key long, doc_id long, place long, copy boolean")


def piece_texts(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(minimizer, doc_id, start, piece) of the wanted (minimizer, doc_id, place)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("minimizer", "place")).alias("wanted"))  # no more than a text has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ident, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                data = _bytes(text)
                rows += [(w["minimizer"], ident, w["place"] >> 8, data[w["place"] >> 8 : (w["place"] >> 8) + (w["place"] & 255) + LENGTH - 1]) for w in wanted]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["minimizer", "doc_id", "start", "piece"])

    return own.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(run, "minimizer long, doc_id long, start long, piece binary")


def repeated_in_collections(texts: DataFrame) -> DataFrame:
    """(doc_id, place) of runs of strings that also start earlier, within pieces of equal minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, starts = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            doc, offset = later_strings([h[3] for h in held], ids, starts)
            order = np.lexsort((offset, doc))
            doc, offset = doc[order], offset[order]
            head = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1))
            count = np.diff(np.append(head, len(doc)))
            return pa.RecordBatch.from_arrays([pa.array(ids[doc[head]]), pa.array((starts[doc[head]] + offset[head]) << 8 | count)], ["doc_id", "place"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("minimizer", "doc_id", "start", "piece"))):
                if size >= COLLECTION and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return texts.repartition("minimizer").sortWithinPartitions("minimizer").mapInArrow(run, "doc_id long, place long")


def repeated_spans(own: DataFrame) -> DataFrame:
    """(doc_id, place: start * 256 + strings) of runs of strings that also start earlier."""
    found = shared_table(repeated_pieces(piece_rows(own)))
    different = found.where("not copy").select(F.col("key").alias("minimizer"), "doc_id", "place")
    return found.where("copy").select("doc_id", "place").unionByName(repeated_in_collections(piece_texts(own, different)))


def removed_runs(size: int, places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings at `places`."""
    runs: list[tuple[int, int]] = []
    for p in sorted(places):
        s, e = p >> 8, min(size, (p >> 8) + (p & 255) + LENGTH - 1)
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        elif s < e:
            runs.append((s, e))
    return runs


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay of each whole text."""
    bounded_batches(docs.sparkSession)
    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    spans = repeated_spans(own).groupBy("doc_id").agg(F.collect_set("place").alias("places"))  # no more than a text has
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ident, text, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                data = _bytes(text)
                runs = removed_runs(len(data), places or [])
                at, kept = 0, []
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                rows.append((ident, len(data), sum(e - s for s, e in runs), len(runs), b"".join(kept) + data[at:]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 4 else pa.int64()) for k in range(5)], names)

    joined = own.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same for a few short texts, string by string."""
    first: dict[bytes, tuple[int, int]] = {}
    for ident, text in rows:
        data = _bytes(text)
        for s in range(len(data) - length + 1):
            first[data[s : s + length]] = min(first.get(data[s : s + length], (ident, s)), (ident, s))
    out = []
    for ident, text in rows:
        data = _bytes(text)
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (ident, s):
                gone[s : s + length] = True
        edges = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((ident, len(data), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
