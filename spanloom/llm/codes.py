"""Vector codes by product quantisation with delta-maintained Lloyd rounds.

Components become integers, vectors are cut into PARTS equal parts, and each part position has a codebook of at most
ENTRIES entries. The state of a round is a table in the shared folder: every vector with its codes and the codes before.
A round assigns all parts (a pass over the table without a shuffle), and what is shuffled is, for parts whose assignment
changed alone, the entry that they came to (plus) and the one that they left (minus), summed within each task first: at
most 2 x PARTS x ENTRIES rows a task. The running sums and counts are PARTS x ENTRIES rows, whatever the table holds. They
are integers, so they equal sums made anew, and a task that runs twice changes nothing.

Defined results: rows whose vector is null, empty or holds null or non-finite components are dropped, and so are those of
another length than the first kept vec_id's; repeated rows are vectors of their own (of equal vec_ids the lesser vector
comes first among the ENTRIES first). With fewer vectors than ENTRIES a codebook is smaller; an empty table has none and
gives no rows. Lengths that PARTS doesn't divide are filled up with zeros; scaled components are held within +-LARGEST, so
that distances fit a long; a sum over labels that doesn't is null. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, shared_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26
#: Vectors whose distances are worked out at a time.
CHUNK = 1024


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): x holds 32-bit integers; only vectors whose components are all finite."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = own.where(finite & (F.size("v") > 0))
    scaled = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * SCALE))).cast("int"))
    return kept.select("vec_id", "label", scaled.alias("x"))


def cut(grid: np.ndarray) -> np.ndarray:
    """Rows of integers as (row, part, component), zeros at the end where PARTS doesn't divide the length."""
    return np.pad(grid, ((0, 0), (0, -grid.shape[1] % PARTS))).reshape(len(grid), PARTS, -1).astype(np.int64)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts (row, part, component): the nearest entry's number and its squared distance; of equal ones the first."""
    codes, errors = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for k in range(0, len(x), CHUNK):
        apart = x[k : k + CHUNK, :, None] - books
        d = np.einsum("npec,npec->npe", apart, apart)
        codes[k : k + CHUNK] = d.argmin(2)
        errors[k : k + CHUNK] = d.min(2)
    return codes, errors


def grid_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), -1)


def assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The state with new codes; those before move to `before`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, errors = assigned(cut(grid_of(b)), books)
                held = [b.column("vec_id"), b.column("label"), b.column("x"), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), b.column("codes"), pa.array(errors.sum(1))]
                yield pa.RecordBatch.from_arrays(held, ["vec_id", "label", "x", "codes", "before", "error"])

    kind = state.schema["label"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id long, label {kind}, x array<int>, codes binary, before binary, error long")


def deltas(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, n, sums): what entries gain less what they lose, over parts whose assignment changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        touched = np.zeros(shape[:2], bool)
        for b in batches:
            if b.num_rows:
                x = cut(grid_of(b))
                now, before = (np.frombuffer(b"".join(v if v is not None else b"\xff" * PARTS for v in b.column(c).to_pylist()), np.uint8).reshape(-1, PARTS) for c in ("codes", "before"))
                row, part = np.nonzero(now != before)
                for codes, sign in ((now, 1), (before, -1)):
                    entry = codes[row, part]
                    real = entry != 255
                    at = (part[real], entry[real])
                    np.add.at(n, at, sign)
                    np.add.at(sums, at, sign * x[row[real], part[real]])
                    touched[at] = True
        part, entry = np.nonzero(touched)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    moved = state.where("before is null or codes <> before").select("x", "codes", "before")
    return moved.mapInArrow(run, "part int, entry int, n long, sums array<long>")


def summed(rows: DataFrame) -> DataFrame:
    """(part, entry, n, sums), one row for each entry."""
    one = rows.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    each = one.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    return each.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]).alias("sums"))


def first_books(vectors: DataFrame) -> np.ndarray | None:
    """The codebooks to begin with, (part, entry, component): of the vectors of the ENTRIES smallest ids."""
    rows = [r.x for r in vectors.orderBy("vec_id", "x").limit(ENTRIES).collect()]
    rows = [x for x in rows if len(x) == len(rows[0])]
    return cut(np.array(rows)).swapaxes(0, 1) if rows else None


def product_codes(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes binary, error) of each kept vector, and the codebooks (part, entry, component)."""
    bounded_batches(vectors.sparkSession)
    start = integer_vectors(vectors, id_col, vector_col, label_col)
    first = start.orderBy("vec_id", "x").select(F.size("x")).first()
    size = first[0] if first else 0
    state = shared_table(start.where(F.size("x") == size).withColumn("codes", F.lit(None).cast("binary")))
    books = first_books(state)
    if books is None:
        return state.select("vec_id", "label", "codes", F.lit(None).cast("long").alias("error")), None
    running = None
    for _ in range(rounds):
        new = shared_table(assign(state, books))
        gained = deltas(new, books.shape)
        total = shared_table(summed(gained if running is None else running.unionByName(gained)))
        for old in (state, running):
            drop_table(old)
        state, running = new, total
        books = books.copy()
        for r in running.collect():  # PARTS x ENTRIES rows
            if r.n:
                books[r.part, r.entry] = [v // r.n for v in r.sums]
    drop_table(running)
    return assign(state, books).select("vec_id", "label", "codes", "error"), books


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept vector."""
    rows, books = product_codes(vectors)
    rows = shared_table(rows)
    text = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    per_label = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    out = rows.join(per_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same report for a table whose vectors all have one length and whose vec_ids differ: each round made anew."""
    near = "(select r.vec_id, r.part, arg_min(b.entry, {'d': %s, 'e': b.entry}) as entry, min(%s) as d from cut r join book%d b using (part) group by r.vec_id, r.part)"
    apart = "list_sum(list_transform(list_zip(r.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} as {near % (apart, apart, k)}")
        if k < rounds:
            sums = f"(select part, entry, pos, sum(v) as s, count(*) as n from (select part, entry, unnest(x) as v, generate_subscripts(x, 1) as pos from near{k} join cut using (vec_id, part)) group by all)"
            new = f"(select part, entry, list(cast(case when s >= 0 then s // n else -((n - 1 - s) // n) end as bigint) order by pos) as x from {sums} group by part, entry)"
            steps.append(f"book{k + 1} as (select b.part, b.entry, coalesce(n.x, b.x) as x from book{k} b left join {new} n using (part, entry))")
    return f"""
with ok as (
  select vec_id, label, list_transform(embedding, lambda v: cast(floor(v::double * {SCALE}) as bigint)) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
), cut as (
  select vec_id, p as part, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] as x from ok cross join range({parts}) r(p)
), book0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from cut
  where vec_id in (select vec_id from ok order by vec_id limit {entries})
), {", ".join(steps)}, coded as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by vec_id
), books as (
  select sha256(string_agg(v, ',' order by part, entry, pos)) as sha from (select part, entry, unnest(x)::varchar as v, generate_subscripts(x, 1) as pos from book{rounds})
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256
from coded join ok using (vec_id) cross join books
"""


SQL = sql()
