"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its five-word shingles. Its sketch has REGISTERS buckets; a bucket keeps, of the
least hash that falls into it, the number of leading zeros (6 bits) and the MANTISSA bits after the leading one. A
bucket without a hash borrows from the first bucket that has one, in an order of its own, so short texts have full
sketches too. Bands of ROWS compressed registers are the search keys.

The work, in rows of bounded size throughout:

1. Documents of equal sets form a class; its smallest doc_id stands for it.
2. Within a band's bucket, each class is compared with the bucket's smallest one only (at most two such pairs for a
   class). Links give components.
3. Buckets that still hold several components are open. Their classes, with sketches and whole sets, go to blocks of at
   most BLOCK_ROWS rows or BLOCK_SHINGLES set members (a larger bucket is dealt over several blocks, and each two of its
   blocks meet once). A block judges the pairs across components, in numpy arrays: no pair becomes a row before it is
   found to be linked, and of the links between two components a block returns one.
4. A pair is first judged by its sketches (Jaccard similarity corrected for registers that agree by chance), then on
   the full sets.

A pair that shares several bands is judged once in each; pairs across components of one bucket grow with the square of a
family of near-threshold texts. No link between different sets that share a bucket is lost.

At similarity 0.75 the bands find a pair with probability 0.9997, at 0.8 with 0.999997; an estimate under the threshold
by MARGIN standard errors leaves out one in some thousands of the pairs exactly at it. Defined results: a text that is
null or has no words has an empty set, links with nothing and stays; repeated rows give repeated rows; rows that share
a doc_id count as one document in links. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, shared_table, shingles, word_hashes

SHINGLE, SIMILARITY = 5, (75, 100)
REGISTERS, ROWS, MANTISSA = 252, 6, 10
BANDS = REGISTERS // ROWS
#: How far, in standard errors, an estimate may be under the threshold for the pair to be verified.
MARGIN = 3.5
#: What a block of an open bucket holds at most (or one class).
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 500_000

#: ORDER[t, j]: the bucket that bucket j asks after t others; itself first.
ORDER = np.argsort(np.random.default_rng(20240229).random((REGISTERS, REGISTERS)) + 1 - 2 * np.eye(REGISTERS), axis=0)


def shingle_set(text: str | None, cache: dict[bytes, int], n: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's distinct n-word shingles."""
    return np.unique(shingles(word_hashes((text or "").encode("utf-8", "surrogatepass"), cache), n))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros of the 53 bits, up to 63, and the MANTISSA bits that follow the leading one."""
    bits = (hashes & np.uint64((1 << 53) - 1)).astype(np.float64).view(np.uint64)
    zeros = np.clip(1075 - (bits >> np.uint64(52)).astype(np.int64), 0, 63)
    return (zeros << MANTISSA | (bits >> np.uint64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)).astype(np.uint16)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS registers for each set, none of them empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((flat >> np.uint64(53)) * np.uint64(REGISTERS) >> np.uint64(11)).astype(np.int64)
    slot = owner * REGISTERS + bucket
    head = np.flatnonzero(np.diff(slot, prepend=-1))  # sets are sorted: ascending by bucket
    low = np.minimum.reduceat(flat & np.uint64((1 << 53) - 1), head) if len(head) else flat
    grid, full = np.zeros(len(sets) * REGISTERS, np.uint16), np.zeros(len(sets) * REGISTERS, bool)
    grid[slot[head]], full[slot[head]] = registers(low), True
    grid, full = grid.reshape(-1), full.reshape(-1)
    todo = np.flatnonzero(~full & np.repeat([len(s) > 0 for s in sets], REGISTERS))
    step = 1
    while len(todo):  # a set that isn't empty fills them within REGISTERS steps
        source = todo // REGISTERS * REGISTERS + ORDER[step, todo % REGISTERS]
        lent = full[source]
        grid[todo[lent]] = grid[source[lent]]
        todo, step = todo[~lent], step + 1
    return grid.reshape(-1, REGISTERS)


def lowest(sizes: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The least estimate with which pairs of set sizes (rows of two) are verified."""
    threshold = similarity[0] / similarity[1]
    own = np.minimum(sizes.min(1), REGISTERS)  # registers that a small set has not borrowed
    return threshold - MARGIN * (threshold * (1 - threshold) / own) ** 0.5


def chance(sizes: np.ndarray) -> np.ndarray:
    """How likely a register of two disjoint sets agrees by chance, for pairs of set sizes (rows of two)."""
    each = np.maximum(sizes / REGISTERS, 1.0)[:, :, None]
    zeros, step = np.arange(40), np.arange(8)
    left = (2.0 ** -(zeros[:, None] + 1) * (1 + step / 8)).reshape(-1)
    width = np.repeat(2.0 ** -(zeros + 1.0), len(step)) / len(step)
    inside = (1 - left) ** each - np.maximum(1 - left - width, 0) ** each  # within an eighth of an octave, even enough
    return (inside[:, 0] * inside[:, 1]).sum(1) * len(step) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two arrays of sketches, corrected for agreement by chance."""
    c = chance(sizes)
    return ((a == b).mean(1) - c) / (1 - c)


def linked(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    """Whether two sets, sorted and distinct, are at least as similar as asked."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return similarity[1] * shared >= similarity[0] * (len(a) + len(b) - shared)


class Block:
    """Classes of one bucket: which pairs across their components are linked."""

    def __init__(self, ids: np.ndarray, components: np.ndarray, halves: np.ndarray, grid: np.ndarray, sets: list[np.ndarray]):
        _, number, often = np.unique(components, return_inverse=True, return_counts=True)
        order = np.lexsort((ids, number, -often[number]))  # the most frequent component first
        self.ids, self.components, self.halves, self.grid = ids[order], number[order], halves[order], grid[order]
        self.sets = [sets[k] for k in order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.judged = 0
        self.codes: np.ndarray | None = None

    def likely(self, k: int, similarity: tuple[int, int]) -> np.ndarray:
        """Rows before row k, of other components, that its sketch says may be linked with it."""
        fits = np.minimum(self.sizes[:k], self.sizes[k]) * similarity[1] >= np.maximum(self.sizes[:k], self.sizes[k]) * similarity[0]
        rows = np.flatnonzero(fits & (self.components[:k] != self.components[k]) & ((self.halves[:k] != self.halves[k]) | (self.halves[k] < 0)))
        self.judged += len(rows)
        if not len(rows):
            return rows
        agree = (self.grid[rows] == self.grid[k]).mean(1)
        sizes, number = np.unique(self.sizes[rows], return_inverse=True)
        both = np.stack((sizes, np.full(len(sizes), self.sizes[k])), 1)
        least, by_chance = lowest(both, similarity)[number], chance(both)[number]
        return rows[(agree - by_chance) / (1 - by_chance) >= least]

    def shared(self, k: int, rows: np.ndarray) -> np.ndarray:
        """Members that the whole sets of rows share with row k's."""
        if self.codes is None:  # members by number, and where each set begins
            names, self.codes = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.mark = np.zeros(len(names), bool)
        own = self.codes[self.begin[k] : self.begin[k] + self.sizes[k]]
        self.mark[own] = True
        out = np.array([np.count_nonzero(self.mark[self.codes[self.begin[j] : self.begin[j] + self.sizes[j]]]) for j in rows])
        self.mark[own] = False
        return out

    def links(self, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
        """Pairs (smaller id, greater id) that are linked, one for each two components."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k in range(int(np.searchsorted(self.components != self.components[0], True)) if len(self.ids) else 0, len(self.ids)):
            rows = self.likely(k, similarity)
            if len(rows):
                both = self.shared(k, rows)
                for j in rows[both * similarity[1] >= (self.sizes[rows] + self.sizes[k] - both) * similarity[0]].tolist():
                    found.setdefault((int(self.components[j]), int(self.components[k])), (int(min(self.ids[j], self.ids[k])), int(max(self.ids[j], self.ids[k]))))
        return sorted(set(found.values()))


# ---- DataFrames ------------------------------------------------------------------------------------------------------

SKETCHES = "doc_id long, n_shingles long, d1 long, d2 long, regs binary"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2: 128-bit digest of the set, regs: the sketch)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache: dict[bytes, int] = {}
        for b in batches:
            sets = [shingle_set(t, cache) for t in b.column("text").to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            rows = sketch(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([r.tobytes() for r in rows], pa.binary())],
                [x.split()[0] for x in SKETCHES.split(", ")],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SKETCHES)


def band_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, id, n): a row for each band of each class."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("regs", k * width + 1, F.lit(width))))
    return nodes.select(F.explode(keys).alias("bucket"), "id", "n")


def connected(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b); a row for each id in a link.

    Alternating large and small stars; the edges of a round are kept in the shared folder.
    """
    edges = shared_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of pairs (a, b) that are linked: judged by sketches first, then on the full sets."""
    side = lambda k: nodes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}"))
    sketched = pairs.join(side("a"), "a").join(side("b"), "b")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                grid = [np.frombuffer(b"".join(b.column(f"regs_{k}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in "ab"]
                sizes = np.stack([b.column(f"n_{k}").to_numpy() for k in "ab"], 1)
                least, keep = lowest(sizes, similarity), (grid[0] == grid[1]).mean(1)
                keep = keep >= least  # chance only adds to agreement
                keep[keep] = estimate(grid[0][keep], grid[1][keep], sizes[keep]) >= least[keep]
                yield b.select(["a", "b"]).filter(pa.array(keep))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            keep = [linked(shingle_set(x, cache), shingle_set(y, cache), similarity) for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    likely = sketched.mapInArrow(judged, "a long, b long")
    return likely.join(text("a"), "a").join(text("b"), "b").mapInArrow(verified, "a long, b long")


def mixed_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, id, n, component) of the buckets that hold several components."""
    grouped = shared.join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = grouped.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return shared_table(grouped.join(mixed, "bucket"))


def whole_sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, regs, whole: the set's members, sorted, as bytes) of each of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            whole = [shingle_set(t, cache).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("regs"), pa.array(whole, pa.binary())], ["id", "regs", "whole"])

    return nodes.join(texts, "id").select("id", "regs", "text").mapInArrow(run, "id long, regs binary, whole binary")


def dealt_blocks(open_rows: DataFrame) -> DataFrame:
    """(block, half, id, component): each row of a bucket in one block, or in as many as its bucket needs.

    In a bucket of several parts, blocks are the pairs of parts; half is -1 in the block of one part alone, where all
    pairs are judged, and the part's number in the others, where only pairs across the two parts are.
    """
    parts = open_rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = open_rows.join(parts, "bucket").withColumn("part", part)
    rows = rows.select("bucket", "id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    block = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    return rows.select(block.alias("block"), F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("half"), "id", "component")


def across_components(open_rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components that share an open bucket."""
    own = texts.join(open_rows.select("id").distinct(), "id", "left_semi")
    rows = dealt_blocks(open_rows).join(whole_sets(nodes, own), "id").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of one block, which may end in a later batch

        def judged() -> list[tuple[int, int]]:
            t = pa.Table.from_batches(held)
            number = lambda c: t.column(c).to_numpy()
            grid = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            return Block(number("id"), number("component"), number("half"), grid, [np.frombuffer(x, np.uint64) for x in t.column("whole").to_pylist()]).links()

        for b in batches:
            keys, out = b.column("block").to_numpy(), []
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if held and hi > lo and held[0].column("block")[0].as_py() != keys[lo]:
                    out += judged()
                    held.clear()
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            out = judged()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of docs."""
    own = id_text(docs, id_col, text_col)
    sk = shared_table(sketches(own))
    key = ["d1", "d2", "n_shingles"]
    classes = sk.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"))
    nodes = shared_table(sk.join(classes, key).where("doc_id = id").select("id", F.col("n_shingles").alias("n"), "regs").dropDuplicates(["id"]))
    bands = band_rows(nodes)
    first = bands.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = shared_table(bands.join(first, "bucket").select("bucket", "id", "n", "pivot"))
    texts = shared_table(own.join(shared.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]))
    votes = shared.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.min("pivot").alias("least"), F.max_by("pivot", F.col("votes")).alias("most"))
    pairs = best.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("a"), F.col("id").alias("b"))
    links = shared_table(similar(pairs, nodes, texts))
    open_rows = mixed_buckets(shared, connected(links))
    if not open_rows.isEmpty():
        links = shared_table(links.unionByName(across_components(open_rows, nodes, texts)))
    component = connected(links)
    member = sk.join(classes, key, "left").select("doc_id", "n_shingles", "id")
    out = member.join(component, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that another one of their component stands for."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
