"""Repair of conversation structure by weighted finite-state composition.

Three machines: an acceptor of the conversation's rows in order (by turn, nulls first, then role and text), an edit
transducer (keep, rerole, delete, insert; at most two inserts in a row, since of three a pair could always be left out)
and an acceptor of the roles `(s?(ua)+)?`. Their composition is expanded lazily, state by state, and its shortest path is
taken in topological order over weights (cost, labels), compared in that order. The labels fix the cost, so labels of
equal cost over the same rows are never prefixes of each other, and least paths stay least when they are continued.

Rows are sorted over the whole table by range, so that a conversation of any length is spread over partitions. A
partition repairs those conversations that lie inside it; of its first and its last one, which may go on elsewhere, it
returns the least paths between each two grammar states, and these are joined afterwards, partition by partition. The
texts of such conversations (two a partition at most) then flow through one task each, in order and in constant memory:
the digest of a conversation is sequential. What is held of one is its labels, a byte a row in each of 10 paths.

Defined results: a null role or text is one space, a null conv_id is a conversation of its own, equal rows are one row
with a count, so that a hot one costs nothing. A turn range beyond a long gives null gaps. Other columns of the input are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_table

SPACE, ENDS = r"\x20\x09-\x0D", ".!?"
#: Costs of the edits; a row that ends without a sentence's end adds CUT_OFF unless it is deleted.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Messages of a chunk of a repaired conversation.
CHUNK = 1000
#: Rows whose paths are extended one by one before they are joined to those before them.
BLOCK = 64

#: The role grammar: 0 nothing yet, 1 a system row, 2 a user's row to be answered, 3 answered.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
NAMES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}

Row = tuple[str, bool, bool, int]
Paths = dict[int, tuple[int, str]]


def relax(paths: Paths, state: int, cost: int, labels: str) -> None:
    if state not in paths or (cost, labels) < paths[state]:
        paths[state] = (cost, labels)


def with_inserts(paths: Paths) -> Paths:
    """paths, continued by up to two inserted messages."""
    out, last = dict(paths), paths
    for _ in range(2):
        new: Paths = {}
        for g, (cost, labels) in last.items():
            for role in "ua":
                if (h := GRAMMAR.get((g, role))) is not None:
                    relax(new, h, cost + INSERT, labels + "I")
        for h, (cost, labels) in new.items():
            relax(out, h, cost, labels)
        last = new
    return out


def shortest(rows: list[Row], start: int) -> Paths:
    """The least (cost, labels) from the grammar state start to each other over rows (role initial, to be deleted, cut off, times)."""
    paths: Paths = {start: (0, "")}
    for initial, gone, cut, times in rows:
        out: Paths = {}
        for g, (cost, labels) in with_inserts(paths).items():
            relax(out, g, cost + DELETE * times, labels + "D" * times)
            if not gone:
                cost += CUT_OFF * cut
                if (h := GRAMMAR.get((g, initial))) is not None:
                    relax(out, h, cost, labels + "K")
                for role in "ua":
                    if (h := GRAMMAR.get((g, role))) is not None:
                        relax(out, h, cost + REROLE, labels + "R")
        paths = out
    return with_inserts(paths)


def best(paths: Paths) -> tuple[int, str]:
    return min(paths[g] for g in FINAL if g in paths)


def joined(a: list[Paths], b: list[Paths]) -> list[Paths]:
    """The least paths over the rows of a and then those of b, from each state."""
    out: list[Paths] = []
    for first in a:
        paths: Paths = {}
        for g, (cost, labels) in first.items():
            for h, (more, rest) in b[g].items():
                if h not in paths or cost + more <= paths[h][0]:
                    relax(paths, h, cost + more, labels + rest)
        out.append(paths)
    return out


class Slice:
    """The rows of one conversation in one partition: counts, and the least paths over them.

    Texts are held only where asked for: for conversations that lie wholly inside the partition.
    """

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]
        self.first = self.last = None
        self.rows: list[Row] = []
        self.joined: list[tuple[int, list[Paths]]] = []  # like a binary counter, so that long paths are copied rarely
        self.texts: list[tuple[str, str, int]] = []

    def add(self, role: str, text: str, times: int, blank: bool, seen: bool, cut: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.counts[3] += self.last + initial not in LEGAL
        self.last = initial
        self.counts[3] += times - 1
        if blank or seen:
            self.counts[0 if blank else 1] += times
            self.rows.append((initial, True, False, times))
        else:
            self.counts[2] += cut
            self.rows.append((initial, False, cut, 1))
            if times > 1:
                self.counts[1] += times - 1
                self.rows.append((initial, True, False, times - 1))
        self.texts.append((role, text, times))

    def fold(self) -> None:
        """Turn the rows held into least paths."""
        for k in range(0, len(self.rows), BLOCK):
            self.joined.append((1, [shortest(self.rows[k : k + BLOCK], g) for g in STATES]))
            while len(self.joined) > 1 and self.joined[-1][0] >= self.joined[-2][0]:
                (m, b), (n, a) = self.joined.pop(), self.joined.pop()
                self.joined.append((m + n, joined(a, b)))
        self.rows = []

    def matrix(self) -> list[Paths]:
        self.fold()
        out = self.joined[-1][1]
        for _, a in self.joined[-2::-1]:
            out = joined(a, out)
        return out


class Messages:
    """Follows the labels of a conversation along its rows: the repaired messages, their digest so far."""

    def __init__(self, labels: str) -> None:
        self.labels, self.at, self.state = labels, 0, 0
        self.digest, self.any = hashlib.sha256(), False
        self.out: list[dict[str, str]] = []

    def _emit(self, role: str, text: str, state: int) -> None:
        self.state = state
        self.digest.update(f"{chr(10) * self.any}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        self.out.append({"role": role, "text": text})

    def inserted(self) -> None:
        while self.labels[self.at : self.at + 1] == "I":
            self.at += 1
            state = GRAMMAR.get((self.state, "u"), 3)
            self._emit(NAMES[state], "", state)

    def row(self, role: str, text: str, times: int) -> None:
        while times:
            self.inserted()
            label = self.labels[self.at]
            if label == "D":  # a run of them at once
                run = min(times, len(self.labels) - self.at)
                run = run if self.labels.startswith("D" * run, self.at) else 1
                self.at += run
                times -= run
                continue
            self.at += 1
            times -= 1
            if label == "K":
                self._emit(role, text, GRAMMAR[self.state, role[:1]])
            else:
                state = GRAMMAR.get((self.state, "u"), 3)
                self._emit(NAMES[state], text, state)


MESSAGES = "messages array<struct<role: string, text: string>>"
#: Counts and paths are on a conversation's last chunk; `parts` is null where the conversation is whole.
SLICES = f"conv_id long, chunk int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string, {MESSAGES}, place int, first string, last string, parts array<struct<from_state: int, to_state: int, cost: long, labels: string>>"
FIELDS = ["conv_id", "chunk", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256", "messages"]


def chunks(conv_id: int | None, m: Messages, done: dict | None, number: int) -> dict:
    """One chunk; done holds the columns of the last one."""
    row = dict.fromkeys(FIELDS) | {"conv_id": conv_id, "chunk": number, "messages": m.out}
    m.out = []
    return row if done is None else row | done | {"sha256": m.digest.hexdigest()}


def ordered_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, n, blank, cut, seen): distinct rows with their number; seen: an earlier row says the same."""
    own = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(k) for c, k in ((role_col, "role"), (text_col, "text"))))
    rows = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = shared_table(rows.select("*", said.alias("said"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[{ENDS}][{SPACE}]*\z")).alias("cut")))
    again = rows.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("earliest"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv_id").alias("conv"), F.col("said").alias("same"), F.col("earliest.turn").alias("earliest"))
    seen = F.col("same").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest"))
    both = rows.join(again, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("same")), "left")
    return both.select("conv_id", "turn", "role", "text", "n", "blank", "cut", seen.alias("seen"))


def slices(rows: DataFrame) -> DataFrame:
    """SLICES: whole conversations repaired, and the parts of those that may lie in several partitions."""
    spread = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")), F.substring("text", 1, 64).asc())
    spread = spread.sortWithinPartitions(*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")))
    schema = F.lit(None).cast(f"struct<{SLICES}>")
    kind = rows.sparkSession.range(0).select(schema.alias("x")).select("x.*").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        place, arrow = TaskContext.get().partitionId(), to_arrow_schema(kind)
        held: tuple[int | None, Slice] | None = None
        inside = False  # a conversation before this one began in this partition

        def part(conv_id: int | None, s: Slice) -> dict:
            parts = [{"from_state": g, "to_state": h, "cost": c, "labels": w} for g, paths in enumerate(s.matrix()) for h, (c, w) in paths.items()]
            return {"conv_id": conv_id, "place": place, "first": s.first, "last": s.last, "parts": parts} | dict(zip(("blank", "duplicate", "truncated", "illegal"), s.counts))

        def whole(conv_id: int | None, s: Slice) -> Iterator[dict]:
            cost, labels = best(shortest(s.rows, 0) if len(s.rows) <= BLOCK else s.matrix()[0])
            m, number = Messages(labels), 0
            for x in s.texts:
                m.row(*x)
                if len(m.out) >= CHUNK:
                    yield chunks(conv_id, m, None, number)
                    number += 1
            m.inserted()
            yield chunks(conv_id, m, dict(zip(("blank", "duplicate", "truncated", "illegal"), s.counts)) | {"cost": cost, "audit": labels}, number)

        for b in batches:
            out: list[dict] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "blank", "seen", "cut"))):
                if held is None or held[0] != row[0]:
                    if held is not None:
                        out += whole(*held) if inside else [part(*held)]
                        inside = True
                    held = (row[0], Slice())
                held[1].add(*row[1:])
                if not inside and len(held[1].rows) >= BLOCK:
                    held[1].fold()
                if not inside:
                    held[1].texts.clear()
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([part(*held)], schema=arrow)

    return spread.mapInArrow(run, SLICES)


def joined_parts(parts: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of conversations that were cut by partitions."""
    names = ["blank", "duplicate", "truncated", "illegal"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        counts, paths, last = [0] * 4, [{g: (0, "")} for g in STATES], None
        for r in rows:
            step: list[Paths] = [{} for _ in STATES]
            for p in r["parts"]:
                step[p["from_state"]][p["to_state"]] = (p["cost"], p["labels"])
            paths = joined(paths, step)
            counts = [n + r[k] for n, k in zip(counts, names)]
            counts[3] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
        cost, labels = best(paths[0])
        return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64())} | {k: pa.array([int(n)], pa.int64()) for k, n in zip([*names, "cost"], [*counts, cost])} | {"audit": pa.array([labels])})

    return parts.select("conv_id", "place", "first", "last", "parts", *names).groupBy("conv_id").applyInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def followed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """FIELDS of the conversations of known, whose rows flow through one task in order, behind their labels."""
    kind = rows.sparkSession.range(0).select(F.lit(None).cast(f"struct<{SLICES}>").alias("x")).select("x.*").select(*FIELDS).schema
    head = known.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"))), F.struct("blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("done"))
    own = rows.join(known.select(F.col("conv_id").alias("conv")), F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi")
    body = own.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n", F.lit(None).cast(head.schema["done"].dataType).alias("done"))
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*(F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, m, conv, done, number = to_arrow_schema(kind), None, None, None, 0
        for b in batches:
            out: list[dict] = []
            for conv_id, first, role, text, n, labels in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "n", "done"))):
                if first == 0:
                    if m is not None:
                        m.inserted()
                        out.append(chunks(conv, m, done, number))
                    m, conv, done, number = Messages(labels["audit"]), conv_id, labels, 0
                else:
                    m.row(role, text, n)
                    if len(m.out) >= CHUNK:
                        out.append(chunks(conv, m, None, number))
                        number += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if m is not None:
            m.inserted()
            yield pa.RecordBatch.from_pylist([chunks(conv, m, done, number)], schema=arrow)

    return stream.mapInArrow(run, kind)


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, chunk, blank, duplicate, truncated, illegal, cost, audit, sha256, messages): the repaired conversations.

    A conversation has a row for each CHUNK messages; its last row holds the fault counts, the cost and labels of the
    edits, and the digest of all its messages (null in the others).
    """
    bounded_batches(conversations.sparkSession)
    rows = shared_table(ordered_rows(conversations, conv_col, turn_col, role_col, text_col))
    out = shared_table(slices(rows))
    known = shared_table(joined_parts(out.where("parts is not null")))
    return out.where("parts is null").select(*FIELDS).unionByName(followed(rows, known))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut off, repeated or reroled by a checksum of `conv_id:turn`."""
    space = F.lit(" ")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = (F.crc32(name.cast("binary")) % 20).cast("int")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    hit = own.withColumn("fault", fault).where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    return hit.select("conv_id", "turn", "role", "text", F.explode(F.expr("if(fault = 3, array(1, 2), array(1))")).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after damage."""
    hit = damaged(conversations)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    turns = hit.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    turns = turns.select(F.col("conv_id").alias("conv_t"), F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise((wide("hi") - wide("lo") + 1 - wide("n")).try_cast("long")).alias("gaps"))
    done = repair_conversations(hit).where("sha256 is not null").withColumnRenamed("conv_id", "conv_d")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(turns, F.col("conv_id").eqNullSafe(F.col("conv_t")), "left").join(done, F.col("conv_id").eqNullSafe(F.col("conv_d")), "left")
    zero = F.lit(0).cast("long")
    gaps = F.when(F.col("conv_d").isNull() & F.col("sha256").isNull(), zero).otherwise(F.col("gaps"))
    return out.select("conv_id", gaps.alias("gaps"), *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same report, with the machines' steps written out as folds over lists.
SQL = r"""
with own as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations
), crc as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, i) order by i) as t from range(256) r(i)
), marked as (
  select own.*, xor(list_reduce(list_transform(string_split(name, ''), lambda c: ord(c)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as fault
  from own cross join crc
), hit as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when fault = 3 then [1, 2] else [1] end) as copy
  from marked where fault <> 0
), said as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut
  from hit
), placed as (
  select *, blank or seen as gone, cut and not (blank or seen) as short, role[1] as initial,
    lag(role[1]) over (partition by conv_id order by turn nulls first, role, text, copy) as before
  from said
), conv as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (blank) as blank, count(*) filter (seen and not blank) as duplicate, count(*) filter (short) as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
    list({'role': role, 'text': text, 'i': initial, 'gone': gone, 'pen': case when short then 5 else 0 end} order by turn nulls first, role, text, copy) as rws
  from placed group by conv_id
), paths as (
  select *, list_reduce(rws, lambda p, x: list_transform([{
      's0': {'c': p.s0.c + 2, 'l': p.s0.l || 'D'},
      's1': list_min([{'c': p.s1.c + 2, 'l': p.s1.l || 'D'}, {'c': case when x.gone or x.i <> 's' then 1000000000000 else p.s0.c + x.pen end, 'l': p.s0.l || 'K'}]),
      'u': list_min([{'c': p.u.c + 2, 'l': p.u.l || 'D'}] || list_transform([p.s0, p.s1, p.a], lambda q: {'c': case when x.gone then 1000000000000 else q.c + x.pen + case when x.i = 'u' then 0 else 1 end end, 'l': q.l || case when x.i = 'u' then 'K' else 'R' end})),
      'a': list_min([{'c': p.a.c + 2, 'l': p.a.l || 'D'}, {'c': case when x.gone then 1000000000000 else p.u.c + x.pen + case when x.i = 'a' then 0 else 1 end end, 'l': p.u.l || case when x.i = 'a' then 'K' else 'R' end}])
    }], lambda y: {
      's0': y.s0, 's1': y.s1,
      'u': list_min([y.u, {'c': y.s0.c + 5, 'l': y.s0.l || 'I'}, {'c': y.s1.c + 5, 'l': y.s1.l || 'I'}, {'c': y.a.c + 5, 'l': y.a.l || 'I'}]),
      'a': list_min([y.a, {'c': y.u.c + 5, 'l': y.u.l || 'I'}, {'c': y.s0.c + 10, 'l': y.s0.l || 'II'}, {'c': y.s1.c + 10, 'l': y.s1.l || 'II'}])
    })[1],
    {'s0': {'c': 0::bigint, 'l': ''}, 's1': {'c': 1000000000000::bigint, 'l': ''}, 'u': {'c': 5::bigint, 'l': 'I'}, 'a': {'c': 10::bigint, 'l': 'II'}}) as p
  from conv
), least as (select *, list_min([p.s0, p.a]) as w from paths),
told as (
  select *, list_reduce(string_split(w.l, ''), lambda o, e: {
    'n': o.n + case when e = 'I' then 0 else 1 end,
    'g': case when e = 'D' or e = '' then o.g when e = 'K' then rws[o.n + 1].i when o.g = 'u' then 'a' else 'u' end,
    'out': case when e = 'D' or e = '' then o.out else o.out || case when o.g = '' then '' else chr(10) end ||
      case when e = 'K' then rws[o.n + 1].role when o.g = 'u' then 'assistant' else 'user' end || ':' || case when e = 'I' then '' else rws[o.n + 1].text end end
    }, {'n': 0::bigint, 'g': '', 'out': ''}).out as text
  from least
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(w.c, 0) as cost, coalesce(w.l, '') as audit, sha256(coalesce(text, '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join told t on e.conv_id is not distinct from t.conv_id
"""
