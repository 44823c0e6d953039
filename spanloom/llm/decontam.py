"""Benchmark passages in documents, by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of WINDOW characters. A window may be found with `budget` edits: a
region with at most so many edits shares at least length + 1 - Q * (budget + 1) of its q-grams with the window, all
near one diagonal. Shared q-grams are counted in overlapping bands of diagonals; a band that reaches the bound is
verified by banded alignment.

Characters are compared one by one, in lower case, all white space as blanks, so offsets are those of the text. The
benchmark is indexed in parts of at most PART_CHARS characters; the documents are scanned once for each part, whose
index (some hundreds of MB at most, not measured) each worker builds. Defined results: null and empty texts have no passages; items shorter than
SHORTEST characters are looked for as they are, without edits, and blank ones not at all; windows begin at each STEP-th
character, so an excerpt of WINDOW - STEP characters is found wherever it lies, if nothing in it is changed; repeated rows of either table give the rows of one; ties
(several windows or places of one item) are one row, from the first place to the last; an empty table on either side
gives no rows; texts are searched whole, however long, in bounded memory; other columns, however named, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, mix64

Q, WINDOW, STEP, SHORTEST = 8, 80, 8, 24
#: Edits allowed, as a share of a window's length.
EDITS = 0.1
PART_CHARS = 1_000_000
FILTER_BITS = 20
#: Candidates aligned at a time, and q-gram matches counted at a time.
ALIGNED, EXPANDED = 4096, 2_000_000
#: Shorter q-grams, which a band's text must hold before it is aligned; candidates looked at together.
SHORT_Q, LOOKED_AT = 4, 256


def code_points(text: str) -> np.ndarray:
    """Lower-case code points, one for each character; white space is blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cp[(cp <= 32) | (cp == 0xA0)] = 32
    return cp


def short_grams(cp: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each SHORT_Q code points in a row, along the last axis."""
    h = np.zeros((*cp.shape[:-1], cp.shape[-1] - SHORT_Q + 1), np.uint32)
    for k in range(SHORT_Q):
        h = h * np.uint32(0x9E3779B1) + cp[..., k : cp.shape[-1] - SHORT_Q + 1 + k]
    return h


def grams(cp: np.ndarray) -> np.ndarray:
    """A hash of each Q code points in a row."""
    h, width = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < Q:
        h = h[:-width] * np.uint64(0xD1342543DE82EF95 + 2 * width) + (h[width:] >> np.uint64(7)) + h[width:]
        width *= 2
    return h


def rolling(columns: np.ndarray) -> np.ndarray:
    """A hash of each column of code points."""
    h = np.zeros(columns.shape[1], np.uint64)
    for row in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + row + np.uint64(1)
    return h


def edit_budget(length: int) -> int:
    """Edits allowed in a window, few enough for the lemma to ask for a shared q-gram at least."""
    return max(0, min(int(length * EDITS), (length - Q) // Q))


@dataclass
class Index:
    """Windows of benchmark items by their q-grams."""

    items: list[int]  # of each window
    offsets: list[int]  # of each window in its item
    windows: list[np.ndarray]
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # of each key's entries
    window: np.ndarray  # of each entry
    at: np.ndarray  # of each entry: where in the window
    short: dict[int, dict[bytes, list[int]]]  # items under SHORTEST characters: by length, by text

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Index:
        ids, offsets, windows = [], [], []
        short: dict[int, dict[bytes, list[int]]] = {}
        for ident, text in sorted(set(items)):
            cp = code_points(text)
            if len(cp) < SHORTEST:
                if (cp != 32).any():
                    short.setdefault(len(cp), {}).setdefault(cp.tobytes(), []).append(ident)
                continue
            starts = [*range(0, max(1, len(cp) - WINDOW + 1), STEP)]
            if starts[-1] + WINDOW < len(cp):
                starts.append(len(cp) - WINDOW)
            for s in starts:
                ids.append(ident)
                offsets.append(s)
                windows.append(cp[s : s + WINDOW])
        hashes = [grams(w) for w in windows]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        at = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.zeros(0, np.int64)
        return cls(ids, offsets, windows, keys, np.append(first, len(flat)), owner, at, short)

    def __post_init__(self):
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(mix64(self.keys) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.short_keys = {n: np.unique(rolling(np.frombuffer(b"".join(own), np.uint32).reshape(-1, n).T)) for n, own in self.short.items()}
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.budgets = np.array([edit_budget(n) for n in self.sizes], np.int64)
        self.needed = self.sizes + 1 - Q * (self.budgets + 1)
        self.matrix = np.zeros((len(self.windows), WINDOW), np.uint32)
        for row, w in zip(self.matrix, self.windows):
            row[: len(w)] = w
        self.short_grams = np.zeros((len(self.windows), WINDOW - SHORT_Q + 1), np.uint32)
        for row, w in zip(self.short_grams, self.windows):
            row[: len(w) - SHORT_Q + 1] = short_grams(w)
        # what every whole window asks for, and the grams of windows that ask for less
        self.least = int(self.needed[self.sizes == WINDOW].min(initial=WINDOW))
        few = (self.needed < self.least)[self.window]
        self.scarce = np.add.reduceat(few, self.first[:-1]) > 0 if len(self.keys) else np.zeros(0, bool)
        same = len(self.budgets) and (self.budgets == self.budgets[0]).all()
        self.stripe = int(self.budgets[0]) + 1 if same else None  # one width for all windows
        self.reach = 2 * int(self.budgets.max(initial=0)) + 2

    def candidates(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, diagonal) of each unchanged window, and (window, diagonal at which its band begins) of each other band
        that reaches the bound. starts: where texts begin in cp.

        A band holds two stripes of budget + 1 diagonals. Of two bands of a window that follow each other the first is
        returned: an alignment along it covers both.
        """
        none = np.zeros(0, np.int64)
        if len(cp) < Q or not len(self.keys):
            return none, none, none, none
        h = grams(cp)
        hit = np.flatnonzero(self.present[(mix64(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        own = self.keys[spot] == h[hit]
        hit, spot = hit[own], spot[own]
        hit = hit[own_text := np.searchsorted(starts, hit, "right") == np.searchsorted(starts, hit + Q - 1, "right")]
        spot = spot[own_text]
        kept = self.crowded(hit) | self.scarce[spot]
        hit, spot = hit[kept], spot[kept]
        many = self.first[spot + 1] - self.first[spot]
        span = len(cp) + 2 * WINDOW
        total = np.cumsum(many)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, EXPANDED)))
        parts, heads = [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(hit)]):  # a gram that repeats in windows and texts meets itself many times: counted piece by piece
            n = many[lo:hi]
            entry = np.repeat(self.first[spot[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            window, at, place = self.window[entry], self.at[entry], np.repeat(hit[lo:hi], n)
            parts.append(np.unique(window * span + (place - at + WINDOW) // (self.stripe or self.budgets[window] + 1), return_counts=True))
            begin = np.flatnonzero(at == 0)
            heads.append((window[begin], place[begin]))
        if not parts:
            return none, none, none, none
        key, counts = parts[0]
        if len(parts) > 1:
            key, number = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(number, np.concatenate([c for _, c in parts]), len(key)).astype(np.int64)
        following = np.append(key[1:] == key[:-1] + 1, False)
        both = counts + np.where(following, np.append(counts[1:], 0), 0)
        alone = np.append(True, ~following[:-1])  # the band that ends with this stripe begins with an empty one
        bands, sums = np.concatenate((key, key[alone] - 1)), np.concatenate((both, counts[alone]))
        bands = np.sort(bands[sums >= self.needed[bands // span]])
        window, place = (np.concatenate(x) for x in zip(*heads))
        same = self.unchanged(cp, starts, window, place)
        window, place = window[same], place[same]
        stripe = window * span + (place + WINDOW) // (self.budgets[window] + 1)
        bands = bands[~np.isin(bands, np.concatenate((stripe, stripe - 1)))]
        new = np.append(True, bands[1:] != bands[:-1] + 1)[: len(bands)]  # runs of bands: each second one is covered
        bands = bands[(np.arange(len(bands)) - np.maximum.accumulate(np.where(new, np.arange(len(bands)), 0))) % 2 == 0] if len(bands) else bands
        return window, place, bands // span, (bands % span) * (self.budgets[bands // span] + 1) - WINDOW

    def crowded(self, hit: np.ndarray) -> np.ndarray:
        """Whether each shared gram's place has as many others near it as a whole window's region must hold."""
        n = self.least
        if len(hit) < n:
            return np.zeros(len(hit), bool)
        first = np.flatnonzero(hit[n - 1 :] - hit[: len(hit) - n + 1] <= WINDOW + int(WINDOW * EDITS) - Q)
        steps = np.zeros(len(hit) + 1, np.int64)
        steps[first] += 1
        steps[first + n] -= 1
        return np.cumsum(steps[:-1]) > 0

    def unchanged(self, cp: np.ndarray, starts: np.ndarray, window: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each window stands at its place as it is, within one text."""
        size = self.sizes[window]
        same = place + size <= np.append(starts, len(cp))[np.searchsorted(starts, place, "right")]
        for k in range(0, WINDOW, 16):  # most differ early
            at = np.flatnonzero(same & (size > k))
            cut = np.arange(k, min(k + 16, WINDOW))
            inside = cut < size[at, None]
            same[at] = (~inside | (cp[np.minimum(place[at, None] + cut, len(cp) - 1)] == self.matrix[window[at, None], cut])).all(1)
        return same

    def likely(self, cp: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Whether the text that an alignment along the band can reach holds enough of each window's short q-grams.

        Of those of a window, at most SHORT_Q fall to an edit. A gram counts wherever it stands, so nothing that can be
        aligned is left out.
        """
        out = np.zeros(len(window), bool)
        n = self.sizes - SHORT_Q + 1
        needed = n - SHORT_Q * self.budgets
        places = np.arange(WINDOW + 2 * self.reach)
        for k in range(0, len(window), LOOKED_AT):
            w = window[k : k + LOOKED_AT]
            text = short_grams(cp[np.clip((diagonal[k : k + LOOKED_AT] - self.reach // 2)[:, None] + places, 0, len(cp) - 1)])
            held = (self.short_grams[w][:, :, None] == text[:, None, :]).any(2) & (np.arange(WINDOW - SHORT_Q + 1) < n[w, None])
            out[k : k + LOOKED_AT] = held.sum(1) >= needed[w]
        return out

    def align(self, cp: np.ndarray, lows: np.ndarray, highs: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in cp) of the best alignment of each window along the band that begins at `diagonal`, within its text."""
        reach = self.reach
        columns = 2 * reach + 1
        origin = diagonal - reach // 2  # DP cell (i, k): i characters of the window, origin + i + k of the text
        big = 1 << 14
        k = np.arange(columns)
        cost = np.zeros((len(window), columns), np.int32)
        text = np.append(cp, np.uint32(0xFFFFFFFF))
        best, end = np.full(len(window), big), np.zeros(len(window), np.int64)
        for i in range(WINDOW):
            live = self.sizes[window] > i
            at = origin[:, None] + i + k
            inside = (at >= lows[:, None]) & (at < highs[:, None])
            differs = (text[np.where(inside, at, len(cp))] != self.matrix[window, i][:, None]).astype(np.int32)
            step = np.minimum(cost + np.where(inside, differs, big), np.concatenate((cost[:, 1:], np.full((len(window), 1), big)), 1) + 1)
            step = np.minimum.accumulate(step - k, axis=1) + k  # text characters left out
            cost = np.where(live[:, None], step, cost)
            done = self.sizes[window] == i + 1
            if done.any():
                best[done] = cost[done].min(1)
                end[done] = origin[done] + i + 1 + cost[done].argmin(1)
        return best, end

    def whole(self, cp: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of each place where a short item stands in cp."""
        for n, own in self.short.items():
            if len(cp) >= n:
                view = np.lib.stride_tricks.sliding_window_view(cp, n)
                for at in np.flatnonzero(np.isin(rolling(view.T), self.short_keys[n])).tolist():
                    for item in own.get(view[at].tobytes(), ()):
                        yield item, at, at + n

    def passages(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item, windows found, least edits, start, end) of each item found in each text."""
        points = [code_points(t) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        starts = np.cumsum(sizes) - sizes
        cp = np.concatenate(points) if points else np.zeros(0, np.uint32)
        same, place, window, diagonal = self.candidates(cp, starts)
        found: dict[tuple[int, int], list] = {}
        text = np.searchsorted(starts, place, "right") - 1
        for w, of, begin in zip(same.tolist(), text.tolist(), (place - starts[text]).tolist() if len(text) else []):
            row = found.setdefault((of, self.items[w]), [set(), 0, begin, begin + int(self.sizes[w])])
            row[0].add(w)
            row[1:] = [0, min(row[2], begin), max(row[3], begin + int(self.sizes[w]))]
        near = self.likely(cp, window, diagonal)
        window, diagonal = window[near], diagonal[near]
        for c in range(0, len(window), ALIGNED):
            w, d = window[c : c + ALIGNED], diagonal[c : c + ALIGNED]
            of = np.clip(np.searchsorted(starts, d + self.sizes[w] // 2 + self.budgets[w], "right") - 1, 0, None)
            while (empty := sizes[of] == 0).any():  # an empty text begins where the next one does
                of[empty] -= 1
            edits, end = self.align(cp, starts[of], starts[of] + sizes[of], w, d)
            for j in np.flatnonzero(edits <= self.budgets[w]):
                stop = int(end[j] - starts[of[j]])
                begin = max(0, stop - int(self.sizes[w[j]]))
                row = found.setdefault((int(of[j]), self.items[w[j]]), [set(), WINDOW, begin, stop])
                row[0].add(int(w[j]))
                row[1:] = [min(row[1], int(edits[j])), min(row[2], begin), max(row[3], stop)]
        for of, own in enumerate(points):
            for item, begin, stop in self.whole(own):
                row = found.setdefault((of, item), [{-1}, 0, begin, stop])
                row[2:] = [min(row[2], begin), max(row[3], stop)]
        return [(of, item, len(r[0]), r[1], r[2], r[3]) for (of, item), r in sorted(found.items())]


PASSAGES = "doc_id long, item_id long, n_windows long, edits long, start long, end long"


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of at most PART_CHARS characters (or one item)."""
    part, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        if part and size + len(r["t"]) > PART_CHARS:
            yield part
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += len(r["t"])
    yield part


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, edits, start, end): a row for each document and each benchmark item of which it holds a window."""
    bounded_batches(docs.sparkSession)
    own, context = id_text(docs, id_col, text_col), docs.sparkSession.sparkContext

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        shared = context.broadcast(part)  # at most PART_CHARS characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index.build(shared.value)
            for b in batches:
                rows = index.passages([t or "" for t in b.column("text").to_pylist()])
                ids = b.column("doc_id").to_pylist()
                columns = [pa.array([ids[r[0]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PASSAGES.split(", ")])

        return own.mapInArrow(run, PASSAGES)

    parts = [scan(p) for p in benchmark_parts(benchmark)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.dropDuplicates()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage."""
    bad = find_passages(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
