"""Embedding near-duplicates: exact pairs at a cosine threshold by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). A tree covers the vectors of one label by
nested levels of halving radii: a node's centre is one of its vectors and stays the centre of one of its children, the
centres of a level are farther apart than its radius, and each node knows how far its vectors really reach. Two nodes
whose centres are farther apart than the threshold and both reaches cannot hold a pair and are left out together; two
whose centres and reaches lie within it are linked as a whole, without a look at their vectors.

The upper levels are grown in Spark, one round a level: nodes of more than CELL vectors choose the centres of their
children from a sample by hash of at most some SAMPLE vectors (a node's salted groups of at most CELL rows then go to the
nearest of them; the reach is measured over all). A node that a round doesn't divide is dealt into cells by hash. Node
pairs are followed down the levels by joins, and a pair of leaves that survives is a unit of work of at most 2 x CELL
vectors: two small trees, traversed against each other in numpy blocks. Cells differ in nothing but place: every pair of
vectors is either in a surviving unit or proved apart.

Vectors without structure (random directions) can't be proved apart by any ball: the units are then all pairs of cells of
a label, N x N / CELL rows and N x N distances, in bounded tasks. A unit returns no pairs, but the links of each vector
as a number and one edge for each vector that isn't alone.

Defined results: rows whose vec_id or label is null, or whose vector is null, empty, zero or holds null or non-finite components,
link with nothing; so do vectors of different lengths. Equal vectors of one label are one node with a count. Rows that
share a vec_id are one vertex of the components, and each has its own links. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_table
from .neardup import connected

COSINE = 0.93
#: Vectors of a cell, vectors that a node's children are chosen from, children of a node and levels at most.
CELL, SAMPLE, FAN, LEVELS = 4096, 256, 16, 12
#: A small tree's nodes of so many vectors are not divided; rows of a block of distances; children after which a node
#: stays whole if they hold less than two vectors each.
LEAF, ROWS, PROBE = 48, 256, 16
#: More than single precision can be off by in a product of unit vectors of some thousands of components.
SINGLE = 1e-3
#: Room for rounding: what lies so near a bound is looked at closely.
EPS = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Tree:
    """A cover tree over rows of unit vectors: nodes by number, root 0, leaves of at most LEAF vectors or of equal place."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.single = x, x.astype(np.float32)
        self.centre: list[int] | np.ndarray = []
        self.reach: list[float] | np.ndarray = []
        self.members: list[np.ndarray] = []
        self.children: list = []
        self._grow(np.arange(len(x)), 0, 2.0)
        self.centre, self.reach = np.array(self.centre), np.array(self.reach)
        self.children = [np.array(c, np.int64) for c in self.children]
        self.leaf = np.array([not len(c) for c in self.children])
        self.size = np.array([len(m) for m in self.members])
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.flat = np.concatenate(self.members)

    def _node(self, members: np.ndarray, centre: int) -> int:
        self.centre.append(centre)
        self.reach.append(float(distances(self.x[members], self.x[[centre]]).max()))
        self.members.append(members)
        self.children.append([])
        return len(self.centre) - 1

    def _grow(self, members: np.ndarray, centre: int, radius: float) -> None:
        open_nodes = [(self._node(members, centre), radius)]
        while open_nodes:
            node, radius = open_nodes.pop()
            members = self.members[node]
            if len(members) <= LEAF or self.reach[node] <= EPS:
                continue
            while radius / 2 >= self.reach[node]:
                radius /= 2
            rest, first = members, self.centre[node]  # nested: the centre goes on as the first child's
            found: list[tuple[np.ndarray, int]] = []
            while len(rest) and (len(found) != PROBE or len(members) - len(rest) >= 2 * PROBE):
                near = distances(self.x[rest], self.x[[first]])[:, 0] <= radius / 2
                near |= rest == first
                found.append((rest[near], first))
                rest = rest[~near]
                first = int(rest[0]) if len(rest) else first
            if not len(rest):  # else nearly every vector would be a node of its own: they stay together in a leaf
                self.children[node] = [self._node(*x) for x in found]
                open_nodes += [(c, radius / 2) for c in self.children[node]]


class Pairs:
    """Dual traversal of two trees (or of one with itself): links of each vector, and what hangs together."""

    def __init__(self, a: Tree, b: Tree | None, raw_a: np.ndarray, raw_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float) -> None:
        self.a, self.b, self.same = a, b or a, b is None
        self.raw, self.weight, self.cosine = (raw_a, raw_b), (weight_a, weight_b), cosine
        self.near = math.sqrt(2 - 2 * cosine)
        self.links = (np.zeros(len(raw_a), np.int64), np.zeros(len(raw_b), np.int64))
        self.root = np.arange(len(raw_a) + (0 if self.same else len(raw_b)))
        self.seen = 0
        self._descend()

    def _joined(self, i: np.ndarray, j: np.ndarray) -> None:
        """The vectors of i and j hang together, pair by pair; each vector's root is the least one it hangs together with."""
        j = j + (0 if self.same else len(self.raw[0]))
        while len(i):
            p, q = self.root[i], self.root[j]
            apart = p != q
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def _all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Each of i is linked with each of j; the two don't overlap."""
        self.links[0][i] += self.weight[1][j].sum()
        self.links[0 if self.same else 1][j] += self.weight[0][i].sum()
        self._joined(i, np.full(len(i), j[0]))
        self._joined(np.full(len(j), i[0]), j)

    def _leaves(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """The pairs across i and j, or within i."""
        for k in range(0, len(i), ROWS):
            rows = i[k : k + ROWS]
            self.seen += len(rows) * len(j)
            others = j[k:] if own else j
            p, q = np.nonzero(self.a.single[rows] @ self.b.single[others].T >= self.cosine - SINGLE)
            p, q = rows[p], others[q]
            if own:  # i and j are the same list: each pair once
                place = np.empty(len(self.raw[0]), np.int64)
                place[i] = np.arange(len(i))
                once = place[p] < place[q]
                p, q = p[once], q[once]
            self._decide(p, q)

    def _decide(self, p: np.ndarray, q: np.ndarray) -> None:
        """Links among the pairs (p, q) of vectors."""
        dots = np.einsum("ij,ij->i", self.a.x[p], self.b.x[q])
        hit = dots >= self.cosine
        for at in np.flatnonzero(np.abs(dots - self.cosine) < EPS):  # by the definition, where rounding could matter
            x, y = self.raw[0][p[at]], self.raw[1][q[at]]
            hit[at] = float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))) >= self.cosine
        p, q = p[hit], q[hit]
        self.links[0][:] += np.bincount(p, self.weight[1][q], len(self.links[0])).astype(np.int64)
        other = self.links[0 if self.same else 1]
        other[:] += np.bincount(q, self.weight[0][p], len(other)).astype(np.int64)
        self._joined(p, q)

    def _small_leaves(self, m: np.ndarray, n: np.ndarray) -> None:
        """All vector pairs across the leaves m and n, pair by pair of leaves."""
        many, each = self.a.size[m] * self.b.size[n], self.b.size[n]
        stop = np.cumsum(many)
        for lo in range(0, len(m), ROWS * LEAF):  # so many leaf pairs, of LEAF vector pairs at most
            hi = min(len(m), lo + ROWS * LEAF)
            at = np.arange(stop[hi - 1] - (stop[lo] - many[lo]))
            pair = np.repeat(np.arange(lo, hi), many[lo:hi])
            at -= np.repeat(stop[lo:hi] - many[lo:hi] - (stop[lo] - many[lo]), many[lo:hi])
            self._decide(self.a.flat[self.a.start[m[pair]] + at // each[pair]], self.b.flat[self.b.start[n[pair]] + at % each[pair]])

    def _across(self, left: np.ndarray, right: np.ndarray, own: bool = False) -> list[tuple[int, int]]:
        """Those node pairs of left and right that have to be followed down; what is linked or apart as a whole is done with.

        own: left and right are the same nodes, and each two of them meet once.
        """
        a, b, out = self.a, self.b, []
        for k in range(0, len(left), ROWS):
            some, others = left[k : k + ROWS], right[k:] if own else right
            self.seen += len(some) * len(others)
            far = np.minimum(2.0, self.near + a.reach[some][:, None] + b.reach[others] + SINGLE).astype(np.float32)
            p, q = np.nonzero(a.single[a.centre[some]] @ b.single[b.centre[others]].T >= 1 - far * far / 2 - SINGLE)
            if own:
                p, q = p[p < q], q[p < q]
            m, n = some[p], others[q]
            apart = a.x[a.centre[m]] - b.x[b.centre[n]]
            d, reach = np.sqrt(np.einsum("ij,ij->i", apart, apart)), a.reach[m] + b.reach[n]
            whole = d + reach <= self.near - EPS
            for x, y in zip(m[whole].tolist(), n[whole].tolist()):
                self._all(a.members[x], b.members[y])
            follow = ~whole & (d <= self.near + reach + EPS)
            small = follow & a.leaf[m] & b.leaf[n] & (a.size[m] * b.size[n] <= LEAF)
            if small.any():
                self._small_leaves(m[small], n[small])
            follow &= ~small
            out += zip(m[follow].tolist(), n[follow].tolist())
        return out

    def _descend(self) -> None:
        a, b, root = self.a, self.b, np.array([0])
        stack: list[tuple[int, int]] = [(0, 0)] if self.same else self._across(root, root)
        while stack:
            m, n = stack.pop()
            own = self.same and m == n
            ca, cb = a.children[m], b.children[n]
            if not len(ca) and not len(cb):
                self._leaves(a.members[m], b.members[n], own)
            elif own:
                stack += [(c, c) for c in ca.tolist()]
                stack += self._across(ca, ca, True)
            elif not len(cb) or a.reach[m] > 2 * b.reach[n]:
                stack += self._across(ca, np.array([n])) if len(ca) else self._across(np.array([m]), cb)
            elif not len(ca) or b.reach[n] > 2 * a.reach[m]:
                stack += self._across(np.array([m]), cb)
            else:
                stack += self._across(ca, cb)

    def edges(self) -> list[tuple[int, int]]:
        """(k, root) of each vector that isn't its own root; numbers of the second tree follow those of the first."""
        return [(k, int(self.root[k])) for k in np.flatnonzero(self.root != np.arange(len(self.root))).tolist()]


def unit_rows(a: pa.Table, b: pa.Table | None, cosine: float) -> pa.Table:
    """(vec_id, h, links, other): the links found in one unit, and for each vector hanging together with others one of them."""
    raws = [np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, -1) for t in (a, b) if t is not None]
    weights = [t.column("m").to_numpy() for t in (a, b) if t is not None]
    trees = [Tree(unit(x)) for x in raws]
    p = Pairs(trees[0], trees[1] if b is not None else None, raws[0], raws[-1], weights[0], weights[-1], cosine)
    ids = np.concatenate([t.column("vec_id").to_numpy() for t in (a, b) if t is not None])
    hashes = np.concatenate([t.column("h").to_numpy() for t in (a, b) if t is not None])
    links = np.concatenate(p.links[: len(raws)])
    other = ids.copy()
    for k, r in p.edges():
        other[k] = ids[r]
    keep = links > 0
    return pa.table([pa.array(x[keep]) for x in (ids, hashes, links, other)], ["vec_id", "h", "links", "other"])


UNIT = "vec_id long, h long, links long, other long"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x): x holds the components as 64-bit floats; null where the row links with nothing."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    own = own.select("vec_id", "label", F.when(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if v is None else np.array(v, np.float64) for v in b.column("v").to_pylist()]
            scaled = [None if v is None else (v / np.abs(v).max() if not 1e-100 < np.abs(v).max() < 1e100 else v) + 0.0 for v in rows]  # squares must neither vanish nor overflow
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([None if v is None else v.tobytes() for v in scaled], pa.binary())], ["vec_id", "label", "x"])

    return own.mapInArrow(run, f"vec_id long, label {own.schema['label'].dataType.simpleString()}, x binary")


def chosen(samples: DataFrame) -> DataFrame:
    """(node, centres): the children's centres of each open node, out of its sample; the first goes on from the node."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = unit(np.frombuffer(b"".join(t.sort_by("h").column("x").to_pylist()), np.float64).reshape(t.num_rows, -1))
        own = t.column("centre")[0].as_py()
        radius, wanted = t.column("radius")[0].as_py() / 2, t.column("wanted")[0].as_py()
        centres = x[:1] if own is None else np.frombuffer(own, np.float64)[None]
        away = distances(x, centres)[:, 0]
        while len(centres) < wanted and away.max() > radius:  # the farthest first, so centres are apart
            centres = np.vstack((centres, x[away.argmax()]))
            away = np.minimum(away, distances(x, centres[-1:])[:, 0])
        if len(centres) < 2:  # all within the halved radius: the next level begins there
            radius = max(float(away.max()), EPS)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "centres": pa.array([centres.tobytes()], pa.binary()), "radius": pa.array([radius])})

    return samples.groupBy("node").applyInArrow(run, "node long, centres binary, radius double")


def routed(points: DataFrame, centres: DataFrame) -> DataFrame:
    """The points of open nodes, dealt to the nearest of their node's centres."""

    def run(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        if not t.num_rows:
            return kind.empty_table()
        width = len(t.column("x")[0].as_py()) // 8  # a node whose sample is empty goes on whole, around any centre
        grid = np.frombuffer(c.column("centres")[0].as_py(), np.float64).reshape(-1, width) if c.num_rows else np.eye(1, width)
        radius = c.column("radius")[0].as_py() if c.num_rows else 2.0
        d = distances(unit(np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, -1)), grid)
        nearest = d.argmin(1)
        child = np.array([hash_pair(key[0].as_py(), k) for k in range(len(grid))])[nearest]
        held = {k: t.column(k) for k in ("vec_id", "h", "m", "x")}
        return pa.table(held | {"node": pa.array(child), "parent": t.column("node"), "centre": pa.array([grid[k].tobytes() for k in nearest.tolist()], pa.binary()), "radius": pa.array(np.full(t.num_rows, radius)), "away": pa.array(d.min(1))}).select(kind.names)

    schema = "vec_id long, h long, m long, x binary, node long, parent long, centre binary, radius double, away double"
    kind = pa.schema([("vec_id", pa.int64()), ("h", pa.int64()), ("m", pa.int64()), ("x", pa.binary()), ("node", pa.int64()), ("parent", pa.int64()), ("centre", pa.binary()), ("radius", pa.float64()), ("away", pa.float64())])
    deal = points.withColumn("salt", F.pmod("h", "salts").cast("int")).drop("salts")
    every = centres.join(points.groupBy("node").agg(F.max("salts").alias("salts")), "node").select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "centres", "radius")
    return deal.groupBy("node", "salt").cogroup(every.groupBy("node", "salt")).applyInArrow(run, schema)


def hash_pair(node: int, k: int) -> int:
    """A child's number, the same wherever it is worked out."""
    z = (node * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1342543DE82EF95) & (1 << 64) - 1
    z = (z ^ z >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z ^= z >> 32
    return z - (1 << 64) if z >> 63 else z


def grown(points: DataFrame, cell: int, near: float) -> tuple[DataFrame, list[DataFrame]]:
    """The points with the leaf (node, part) that holds them, and the nodes of each level.

    A node is a leaf if a cell holds it, or if it is so small in space that its vectors link with each other anyway.
    """
    state = points.select("vec_id", "h", "m", "x", F.col("top").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("centre"), F.lit(2.0).alias("radius"), F.lit(2.0).alias("away"))
    leaves: list[DataFrame] = []
    levels: list[DataFrame] = []
    for depth in range(LEVELS):
        nodes = shared_table(state.groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("centre").alias("centre"), F.first("radius").alias("radius"), F.max("away").alias("reach")).withColumn("leaf", (F.col("n") <= cell) | (F.col("reach") <= near / 8)))
        levels.append(nodes)
        large = nodes.where("not leaf")
        if depth == LEVELS - 1 or large.isEmpty():
            break
        wide = large.select("node", "n", F.least(F.lit(FAN), F.ceil(2 * F.col("n") / cell)).cast("int").alias("wanted"), F.ceil(2 * F.col("n") / cell).cast("int").alias("salts"))
        leaves.append(state.join(large.select("node"), "node", "left_anti"))
        opened = state.join(wide, "node")
        picked = opened.where(F.pmod(F.xxhash64("h"), F.col("n")) < SAMPLE).select("node", "h", "x", "centre", "radius", "wanted")
        state = shared_table(routed(opened.select("vec_id", "h", "m", "x", "node", "salts"), chosen(picked)))
    leaves.append(state)
    held = leaves[0].select("vec_id", "h", "m", "x", "node")
    for more in leaves[1:]:
        held = held.unionByName(more.select("vec_id", "h", "m", "x", "node"))
    sizes = levels[-1].select("node", "n")
    for more in levels[:-1]:
        sizes = sizes.unionByName(more.where("leaf").select("node", "n"))
    parts = sizes.select("node", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    held = held.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("h", "node"), "parts").cast("int"))
    return held, levels


def node_pairs(levels: list[DataFrame], near: float) -> DataFrame:
    """(a, b): pairs of leaves that may hold a pair of vectors, by dual traversal from the roots; a leaf with itself too."""
    top = levels[0]
    pairs, done = top.where("not leaf").select(F.col("node").alias("a"), F.col("node").alias("b")), [top.where("leaf").select(F.col("node").alias("a"), F.col("node").alias("b"))]
    closed: DataFrame | None = None  # leaves of earlier levels, which stay nodes of the later ones
    for k, level in enumerate(levels[1:], 1):
        last = k == len(levels) - 1
        keep = level.select("node", "parent", "centre", "reach", (F.lit(last) | F.col("leaf")).alias("leaf"))
        if closed is not None:
            keep = keep.unionByName(closed)
        side = lambda s: keep.select(F.col("parent").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "centre", "reach", "leaf")))  # noqa: E731, B023
        both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))
        schema = "a long, b long, leaves boolean"

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                if t.num_rows:
                    a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64).reshape(t.num_rows, -1) for c in ("centre_a", "centre_b"))
                    d = np.sqrt(((a - b) ** 2).sum(1))
                    keep = d <= near + t.column("reach_a").to_numpy() + t.column("reach_b").to_numpy() + EPS
                    yield pa.RecordBatch.from_arrays([t.column("node_a"), t.column("node_b"), t.column("leaves")], ["a", "b", "leaves"]).filter(pa.array(keep))

        kept = shared_table(both.select("node_a", "node_b", "centre_a", "centre_b", "reach_a", "reach_b", (F.col("leaf_a") & F.col("leaf_b")).alias("leaves")).mapInArrow(apart, schema))
        done.append(kept.where("leaves").select("a", "b"))
        pairs = kept.where("not leaves").select("a", "b")
        closed = keep.where("leaf").withColumn("parent", F.col("node"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def units(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, pa, b, pb, side, vec_id, h, m, x): the vectors of each pair of cells; side 0 and 1, a cell with itself once."""
    parts = held.select("node", "parts").distinct()
    cells = parts.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    side = lambda s: cells.select(F.col("node").alias(s), F.col("part").alias(f"p{s}"))
    each = shared_table(pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b or pa <= pb"))
    one = each.select("a", "pa", "b", "pb", F.col("a").alias("node"), F.col("pa").alias("part"), F.lit(0).alias("side"))
    two = each.where("a <> b or pa <> pb").select("a", "pa", "b", "pb", F.col("b").alias("node"), F.col("pb").alias("part"), F.lit(1).alias("side"))
    return one.unionByName(two).join(held, ["node", "part"]).select("a", "pa", "b", "pb", "side", "vec_id", "h", "m", "x")


def similar_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of vectors."""
    bounded_batches(vectors.sparkSession)
    own = shared_table(usable(vectors, id_col, vector_col, label_col).withColumn("h", F.xxhash64("label", "x")))
    classes = own.where("x is not null").groupBy("label", "x", "h").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"))
    points = shared_table(classes.select("vec_id", "h", "m", "label", "x", F.xxhash64("label", F.length("x")).alias("top")))
    near = math.sqrt(2 - 2 * cosine)
    held, levels = grown(points, cell, near)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sides = [t.filter(pa.compute.equal(t.column("side"), k)) for k in (0, 1)]
        alone = key[0] == key[2] and key[1] == key[3]
        if not alone and not all(s.num_rows for s in sides):
            return t.select(["vec_id", "h"]).slice(0, 0).append_column("links", pa.array([], pa.int64())).append_column("other", pa.array([], pa.int64()))
        return unit_rows(sides[0], None if alone else sides[1], cosine)

    found = shared_table(units(held, node_pairs(levels, near)).groupBy("a", "pa", "b", "pb").applyInArrow(run, UNIT))
    links = found.groupBy("vec_id", "h").agg(F.sum("links").alias("links"))
    components = connected(found.where("vec_id <> other").select(F.col("vec_id").alias("a"), F.col("other").alias("b")).unionByName(copies(own, points)))
    per_class = points.select("label", "x", F.col("vec_id").alias("rep"), "h", "m").join(links.withColumnRenamed("vec_id", "rep"), ["rep", "h"], "left")
    n_links = F.coalesce(F.col("m") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    out = own.select("vec_id", "label", "x").join(per_class, ["label", "x"], "left").select("vec_id", n_links.alias("n_links"))
    out = out.join(components.select(F.col("id").alias("of"), "component"), F.col("vec_id") == F.col("of"), "left")
    return out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))


def copies(own: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): rows of a vector that others have too, each with the least vec_id of them."""
    many = points.where("m > 1").select("label", "x", F.col("vec_id").alias("b"))
    return own.join(many, ["label", "x"]).where("vec_id <> b").select(F.col("vec_id").alias("a"), "b")


def brute_force(rows: list[tuple[int, list[float] | None, object]], cosine: float = COSINE) -> list[tuple[int, int, int, bool]]:
    """The same rows, by all pairs; vec_ids differ."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    links = {k: set() for k in range(len(rows))}
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w, other = rows[j][1:]
            if good[i] and good[j] and label == other and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    root = {}
    for i in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        todo = [i] if i not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = rows[i][0]
                todo += links[k]
    return sorted((r[0], len(links[k]), root[k], root[k] == r[0]) for k, r in enumerate(rows))


#: The same for tables whose vec_ids differ.
SQL = f"""
with recursive ok as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where case when len(a.v) = len(b.v) then list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {COSINE} else false end
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select r.a, l.b from reach r join links l on l.a = r.b
), component as (select a as vec_id, min(b) as component_id from reach group by a)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join component using (vec_id) left join (select a as vec_id, count(*) as n from links group by a) using (vec_id)
"""
