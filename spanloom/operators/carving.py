"""Clips carved out of byte images: NAL units with their ends, and the clip rules along them.

The units of an image are cut into blocks by position, one task a block. What a block makes of its units depends on the
state that it is entered in (the open clip's parameter sets, PPS ids and frame number, units held back, an open orphan),
which is the state that the block before is left in. Blocks are therefore worked out speculatively, first as if nothing
were open, then again wherever the block before was left in another state than assumed, until no entry changes: two or
three rounds where streams repeat their parameter sets, one round a block at most. The result is that of one pass over
the image. A block returns pieces of clips and orphans (counts and extents); pieces of one clip are put together by the
position where it opened.

Rules: a clip opens at a random-access picture behind valid parameter sets that refer to each other and to which the
picture refers, and goes on over units whose headers stay plausible, with at most `max_pad` bytes between them. Sequences
of other pictures are orphans. Damaged, foreign and oversized units end a clip; the reason is kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import removed, sliced, written
from . import bits
from .along import SPAN, following, preceding

#: Bytes of a unit's head that slices are read from, and of a parameter set that is read.
HEAD, RAW = 16, 520
BLOCK = 16 << 20
#: Units held back at most before a picture decides on them.
HELD = 64
#: Unit types that may occur, and what they are.
H264_OTHER, H265_TYPES = {6, 9, 10, 11, 12}, {*range(10), *range(16, 22), *range(32, 41)}
NEEDED = {"h264": {"sps", "pps"}, "h265": {"vps", "sps", "pps"}}
FRAGMENT, NO_SETS = "slices without a preceding IRAP + parameter sets (continuation fragment)", "IRAP picture without parameter sets"


@dataclass(frozen=True)
class Rules:
    max_pad: int = 64
    max_nal: int = 16 << 20
    continuity: bool = True
    check_sets: bool = True
    join_gap: int = 0


# ---- units ---------------------------------------------------------------------------------------


def marks(chunks: DataFrame) -> DataFrame:
    """What start codes and zeros a chunk (img, pos, data, before, after) holds.

    (img, at, hdr, end, head, raw, last, first_end, first_code): the units that begin in it, with their end where it lies
    in the chunk; its last one may go on (last). first_end and first_code, the chunk's first end of a unit and first
    header, are on one row of each chunk that has any.
    """
    runs = re.compile(rb"\x00{2,}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[tuple] = []
            for img, pos, data, before, after in zip(*(b.column(c).to_pylist() for c in ("img", "pos", "data", "before", "after"))):
                lead = before[-4:]
                whole, own = lead + data + after, len(lead)
                limit, shift = own + len(data), pos - own
                ends, codes = [], []
                for m in runs.finditer(whole):
                    s, e = m.span()
                    code = whole[e : e + 1] == b"\1"
                    last_byte = code and e + 1 >= len(whole) and len(after) < RAW  # a start code with nothing behind it
                    if own <= s < limit and (code or e - s >= 3) and not last_byte:
                        ends.append(s)
                    if code and own <= e < limit and not last_byte:
                        codes.append((e + 1, e - s))
                place = 0
                for k, (h, zeros) in enumerate(codes):
                    while place < len(ends) and ends[place] <= h:
                        place += 1
                    end = ends[place] if place < len(ends) else None
                    after_h = codes[k + 1][0] if k + 1 < len(codes) else None
                    if after_h is not None and (end is None or after_h <= end):
                        continue  # another start code begins within this unit's header: there is no unit
                    head = whole[h : h + HEAD]
                    raw = whole[h : h + RAW] if parameter_kind(head) else None
                    out.append((img, h + shift - (4 if zeros >= 3 else 3), h + shift, None if end is None else end + shift, head, raw, k + 1 == len(codes), None, None))
                if ends or codes:
                    out.append((img, pos, None, None, None, None, False, ends[0] + shift if ends else None, codes[0][0] + shift if codes else None))
            types = [b.schema.field("img").type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["img", "at", "hdr", "end", "head", "raw", "last", "first_end", "first_code"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    kind = chunks.schema["img"].dataType.simpleString()
    return chunks.select("img", "pos", "data", "before", "after").mapInArrow(run, f"img {kind}, at long, hdr long, end long, head binary, raw binary, last boolean, first_end long, first_code long")


def parameter_kind(head: bytes) -> tuple[str, str] | None:
    """(codec, part) of a parameter set's header."""
    if head and head[0] < 0x80:
        if head[0] & 0x60 and head[0] & 31 in (7, 8):
            return "h264", "sps" if head[0] & 31 == 7 else "pps"
        if len(head) > 1 and head[1] & 7 and head[0] & 1 == 0 and head[1] >> 3 == 0 and head[0] >> 1 in (32, 33, 34):
            return "h265", ("vps", "sps", "pps")[(head[0] >> 1) - 32]
    return None


def kinds_of(head: bytes) -> dict[str, tuple[str, int]]:
    """For each codec in which the header may occur: what it is ('vcl', 'param' or 'other') and its type."""
    out = {}
    if head and head[0] < 0x80:
        t = head[0] & 31
        if t in (1, 5, 7, 8) or t in H264_OTHER:
            out["h264"] = ("vcl" if t in (1, 5) else "param" if t in (7, 8) else "other", t)
        if len(head) > 1 and head[1] & 7 and head[0] & 1 == 0 and head[1] >> 3 == 0 and head[0] >> 1 in H265_TYPES:
            t = head[0] >> 1
            out["h265"] = ("vcl" if t < 32 else "param" if t < 35 else "other", t)
    return out


def nal_units(chunks: DataFrame, span: int = SPAN) -> DataFrame:
    """(img, at, end, head, raw): each unit from its start code to the next one or the next run of three zeros or more.

    Chunks as of spanloom.sources.images, with an overlap of RAW bytes or more; raw, of parameter sets alone, has up to
    RAW bytes from the start code on. A unit without an end in its chunk is met by the next chunk that has one.
    """
    found = written(marks(chunks))
    firsts = found.where("hdr is null").select("img", "at", F.struct("first_end", "first_code").alias("mark"))
    sizes = chunks.groupBy("img").agg(F.max(F.col("pos") + F.length("data")).alias("size"), F.max_by(F.expr("right(concat(right(before, 2), data), 2)"), "pos").alias("tail"))
    closed = found.where("hdr is not null and end is not null")
    # an open unit stands behind its chunk's mark, at the start code's last byte: the next chunk's mark ends it
    open_units = found.where("hdr is not null and end is null and last").select("img", "at", F.struct("hdr", "head", "raw").alias("unit"), F.lit(None).cast("struct<first_end: bigint, first_code: bigint>").alias("mark"))
    line = firsts.select("img", "at", F.lit(None).cast(open_units.schema["unit"].dataType).alias("unit"), "mark").unionByName(open_units)
    line = following(line.withColumn("order", F.when(F.col("unit").isNull(), F.col("at") * 2).otherwise(F.col("unit.hdr") * 2 - 1)), "img", "order", "mark", 2 * span).where("unit is not null")
    trimmed = F.when(F.expr("right(tail, 2) = X'0000'"), 2).when(F.expr("right(tail, 1) = X'00'"), 1).otherwise(0)
    last = line.join(sizes, "img").select("img", "at", "unit.*", F.col("next_mark").alias("next"), "size", (F.col("size") - F.least(trimmed, F.col("size") - F.col("unit.hdr"))).alias("eof"))
    dropped = F.col("next.first_code").isNotNull() & (F.col("next.first_end").isNull() | (F.col("next.first_code") <= F.col("next.first_end")))
    end = F.when(F.col("next").isNotNull(), F.col("next.first_end")).otherwise(F.greatest("eof", F.col("hdr") + 1))
    ended = last.where(~F.coalesce(dropped, F.lit(False)) & (F.col("size") > F.col("hdr"))).select("img", "at", "hdr", end.alias("end"), "head", "raw")
    units = closed.select("img", "at", "hdr", "end", "head", "raw").unionByName(ended)
    # no more than RAW bytes from the start code on, and none beyond the end
    return units.select("img", "at", "end", "head", F.expr(f"substring(raw, 1, int(least(end - hdr, {RAW} - (hdr - at))))").alias("raw"))


def described(units: DataFrame) -> DataFrame:
    """(img, at, end, codec, part, digest, parameter, types, slice264, slice265): what the clip rules look at, read in batches."""
    sets = [("valid", pa.bool_()), *((n, pa.int32()) for n in bits.NAMES)]
    s264 = pa.struct([("kind", pa.int32()), ("pps", pa.int32()), ("tail", pa.int32()), ("tail_bits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            heads, raws = b.column("head").to_pylist(), b.column("raw").to_pylist()
            named = [parameter_kind(h) for h in heads]
            codec, part = [n and n[0] for n in named], [n and n[1] for n in named]
            kinds = [kinds_of(h) for h in heads]
            found = bits.read_parameters(codec, part, raws)
            digest = [hashlib.sha256(r).hexdigest() if r is not None and n else None for r, n in zip(raws, named)]
            h264: list[dict | None] = [None] * len(heads)
            h265: list[int | None] = [None] * len(heads)
            if at := [k for k, x in enumerate(kinds) if x.get("h264", ("",))[0] == "vcl"]:
                f = bits.h264_slice([heads[k] for k in at])
                for j, k in enumerate(at):
                    if f["read"][j] and not (kinds[k]["h264"][1] == 5 and f["kind"][j] not in (2, 4, 7, 9)):
                        h264[k] = {n: int(f[n][j]) for n in ("kind", "pps", "tail", "tail_bits")}
            if at := [k for k, x in enumerate(kinds) if x.get("h265", ("",))[0] == "vcl"]:
                f = bits.h265_slice([heads[k] for k in at], np.array([kinds[k]["h265"][1] for k in at]))
                for j, k in enumerate(at):
                    if f["read"][j]:
                        h265[k] = int(f["pps"][j])
            arrays = [b.column("img"), b.column("at"), b.column("end"), pa.array(codec, pa.string()), pa.array(part, pa.string()), pa.array(digest, pa.string()), pa.array(found, pa.struct(sets))]
            arrays += [pa.array([x[c][1] if c in x else None for x in kinds], pa.int32()) for c in ("h264", "h265")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(h264, s264), pa.array(h265, pa.int32())], ["img", "at", "end", "codec", "part", "digest", "parameter", "t264", "t265", "slice264", "slice265"])

    kind = units.schema["img"].dataType.simpleString()
    return units.select("img", "at", "end", "head", "raw").mapInArrow(run, f"img {kind}, at long, end long, codec string, part string, digest string, parameter {bits.PARAMETER}, t264 int, t265 int, slice264 struct<kind: int, pps: int, tail: int, tail_bits: int>, slice265 int")


# ---- clip rules ----------------------------------------------------------------------------------


def what(u: dict, codec: str) -> str | None:
    t = u["t264" if codec == "h264" else "t265"]
    if t is None:
        return None
    if codec == "h264":
        return "vcl" if t in (1, 5) else "param" if t in (7, 8) else "other"
    return "vcl" if t < 32 else "param" if t < 35 else "other"


def random_access(u: dict, codec: str) -> bool:
    return u["t264"] == 5 if codec == "h264" else 16 <= u["t265"] <= 21


def picture_set(u: dict, codec: str) -> int | None:
    """The PPS id of a slice; None where its header is implausible."""
    return u["slice265"] if codec == "h265" else u["slice264"] and u["slice264"]["pps"]


def pps_ids(items: list[dict], codec: str) -> set[int]:
    return {i["parameter"]["id"] for i in items if i["codec"] == codec and i["part"] == "pps" and i["parameter"]}


def group_valid(items: list[dict], codec: str) -> bool:
    """Parameter sets that are valid and refer to each other."""
    by = {p: [i["parameter"] for i in items if i["part"] == p] for p in ("vps", "sps", "pps")}
    if any(p is None or not p["valid"] for p in [*by["vps"], *by["sps"], *by["pps"]]) or not by["sps"]:
        return False
    ids = {p["id"] for p in by["sps"]}
    if codec == "h265":
        first = {p["id"] for p in by["vps"]}
        if not first or any(p["refers"] not in first for p in by["sps"]):
            return False
        return -1 in ids or all(p["refers"] in ids for p in by["pps"])
    return all(p["refers"] in ids for p in by["pps"])


ITEM = ("at", "end", "codec", "part", "digest", "parameter", "t264", "t265")


class Walk:
    """The rules along the units of one block, entered in a state and left in one."""

    def __init__(self, entry: str | None, rules: Rules) -> None:
        s = json.loads(entry) if entry else {}
        self.rules = rules
        self.clip: dict | None = s.get("clip")
        self.held: list[dict] = s.get("held", [])
        self.orphan: dict | None = s.get("orphan")
        self.valid_end: int = s.get("valid_end", 0)
        self.pieces: list[dict] = []
        self.clip_piece: dict | None = self._piece("clip", self.clip["codec"], False, None, None) if self.clip else None
        self.orphan_piece: dict | None = self._piece("orphan", self.orphan["codec"], False, None, None) if self.orphan else None
        if self.orphan_piece:
            self.orphan_piece["reason"] = self.orphan["reason"]

    def leave(self) -> str | None:
        """The state left in; None where nothing is open."""
        for p in (self.clip_piece, self.orphan_piece):
            if p is not None:
                self.pieces.append(p)
        if self.clip is None and not self.held and self.orphan is None:
            return None
        return json.dumps({"clip": self.clip, "held": self.held, "orphan": self.orphan, "valid_end": self.valid_end}, sort_keys=True)

    @staticmethod
    def _piece(kind: str, codec: str, opens: bool, s: int | None, e: int | None) -> dict:
        return {"kind": kind, "codec": codec, "opens": opens, "closes": False, "s": [s], "e": [e], "units": 0, "pictures": 0, "access": 0, "reason": None}

    # -- clips

    def close(self, reason: str) -> None:
        if self.clip is not None:
            self.clip_piece |= {"closes": True, "reason": reason}
            self.pieces.append(self.clip_piece)
            self.clip = self.clip_piece = None

    def reach(self, end: int) -> None:
        e = self.clip_piece["e"]
        e[-1] = end if e[-1] is None else max(e[-1], end)

    def count(self, access: bool) -> None:
        self.clip_piece["units"] += 1
        self.clip_piece["pictures"] += 1
        self.clip_piece["access"] += access

    def frame(self, u: dict) -> int | None:
        s = u["slice264"]
        if s is None or self.clip["bits"] is None:
            return None
        return bits.frame_number(s["tail"], s["tail_bits"], self.clip["bits"], self.clip["planes"])

    def continues(self, frame: int | None) -> bool:
        return (frame - self.clip["frame"]) % (1 << self.clip["bits"]) in (0, 1)

    def opened(self, u: dict, codec: str) -> bool:
        """Whether the picture opens a clip with the parameter sets held back."""
        own = [i for i in self.held if i["codec"] == codec]
        if not random_access(u, codec) or not NEEDED[codec] <= {i["part"] for i in own} or picture_set(u, codec) is None:
            return False
        first = self.held.index(own[0])
        while first and self.held[first - 1]["codec"] is None and what(self.held[first - 1], codec) == "other":
            first -= 1  # delimiters and messages right before the parameter sets
        items = [i for i in self.held[first:] if i["codec"] in (None, codec)]
        if self.rules.check_sets and not group_valid(items, codec):
            return False
        ids = pps_ids(items, codec)
        if ids and picture_set(u, codec) not in ids:
            return False
        sps = next((i["parameter"] for i in items if i["part"] == "sps" and codec == "h264"), None)
        self.clip = {"codec": codec, "sets": self.sets(items), "pps": sorted(ids), "frame": None, "bits": sps and sps["frame_num_bits"], "planes": sps["separate_planes"] if sps else 0}
        self.clip_piece = self._piece("clip", codec, True, items[0]["at"], max(i["end"] for i in items))
        self.clip_piece["units"] = len(items)
        self.reach(u["end"])
        self.count(True)
        if codec == "h264":
            self.clip["frame"] = self.frame(u)
        self.held = []
        return True

    @staticmethod
    def sets(items: list[dict]) -> list[list[str]]:
        return [list(x) for x in sorted({(i["part"], i["digest"]) for i in items if i["codec"]})]

    # -- orphans

    def flush(self) -> None:
        if self.orphan is not None:
            self.orphan_piece["closes"] = True
            self.pieces.append(self.orphan_piece)
            self.orphan = self.orphan_piece = None

    def stray_picture(self, u: dict, codec: str, reason: str) -> None:
        if self.orphan is not None and (u["at"] - self.orphan["end"] > self.rules.max_pad or self.orphan["reason"] != reason):
            self.flush()
        if self.orphan is None:
            self.orphan_piece = self._piece("orphan", codec, True, u["at"], None) | {"reason": reason}
        self.orphan = {"end": u["end"], "reason": reason, "codec": self.orphan["codec"] if self.orphan else codec}
        self.orphan_piece["e"] = [u["end"]]
        self.orphan_piece["units"] += 1

    # -- units

    def hold(self, u: dict) -> None:
        self.held = [*self.held, {k: u[k] for k in ITEM}][-HELD:]

    def unit(self, u: dict) -> None:
        if u["end"] - u["at"] > self.rules.max_nal:
            self.valid_end = u["end"]
            self.close("oversize NAL unit")
            self.held = []
            return
        gap = u["at"] - self.valid_end
        if self.clip is not None and what(u, self.clip["codec"]) is None and gap <= self.rules.max_pad and u["codec"] is None:
            return  # a header that can't be one, close behind valid data: junk within a gap
        self.valid_end = u["end"]
        if self.clip is None:
            self.idle(u, gap)
        elif reason := self.end_reason(u, gap):
            if reason != "parameter sets changed":
                self.held = []
            self.close(reason)
            self.idle(u, gap)

    def end_reason(self, u: dict, gap: int) -> str | None:
        """Why the clip ends before the unit; None if it goes on, with the unit taken in."""
        clip, codec = self.clip, self.clip["codec"]
        kind, joined = what(u, codec), False
        if gap > self.rules.max_pad:
            if kind == "vcl" and codec == "h264" and gap <= self.rules.join_gap and clip["frame"] is not None:
                frame = self.frame(u)
                joined = frame is not None and picture_set(u, codec) in clip["pps"] and self.continues(frame)
            if not joined:
                return f"gap of {gap} bytes"
        if kind is None:
            return "invalid NAL header"
        if kind != "vcl":
            self.hold(u)
            return None
        refers = picture_set(u, codec)
        if refers is None:
            return "implausible slice header"
        known = {*clip["pps"], *pps_ids(self.held, codec)}
        if known and refers not in known:
            return "slice references a PPS not seen in the clip"
        access, frame = random_access(u, codec), self.frame(u)
        if codec == "h264" and self.rules.continuity and not access and not joined and clip["frame"] is not None and frame is not None and not self.continues(frame):
            return "frame_num discontinuity (possible splice)"
        if access and any(i["codec"] for i in self.held) and self.sets(self.held) != clip["sets"]:
            return "parameter sets changed"
        clip["pps"] = sorted(known)
        for i in self.held:
            self.reach(i["end"])
        self.clip_piece["units"] += len(self.held)
        self.held = []
        if joined:
            self.clip_piece["s"].append(u["at"])
            self.clip_piece["e"].append(u["end"])
        else:
            self.reach(u["end"])
        self.count(access)
        if codec == "h264" and frame is not None:
            clip["frame"] = frame
        return None

    def idle(self, u: dict, gap: int) -> None:
        if gap > self.rules.max_pad:
            self.held = []
        kinds = {c: k for c in ("h264", "h265") if (k := what(u, c))}
        if not kinds:
            self.held = []
            return
        for codec, kind in kinds.items():
            if kind == "vcl" and self.opened(u, codec):
                self.flush()
                return
        if set(kinds.values()) != {"vcl"}:  # it may belong to a clip that a later picture opens
            self.flush()
            self.hold(u)
            return
        self.held = []
        self.stray_picture(u, next(iter(kinds)), NO_SETS if any(random_access(u, c) for c in kinds) else FRAGMENT)


PIECES = "block long, seq int, kind string, codec string, opens boolean, closes boolean, s array<long>, e array<long>, units long, pictures long, access long, reason string, exit string"


def walked(units: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """Pieces of the blocks of entries (img, block, entry), and of each block a row of kind 'exit'."""
    names = [x.split()[0] for x in PIECES.replace("<long>", "").split(", ")]
    img = units.schema["img"].dataType.simpleString()
    fields = asdict(rules)

    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def left(block: tuple, walk: Walk) -> list[dict]:
        end = walk.leave()
        last = dict.fromkeys(names) | {"kind": "exit", "exit": end}
        return [p | {"img": block[0], "block": block[1], "seq": k, "exit": p.get("exit")} for k, p in enumerate([*walk.pieces, last])]

    def table(out: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(("img", *names), (kind, *kinds))], ["img", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = walk = kind = None
        for b in sliced(batches):
            kind, out = b.schema.field("img").type, []
            for u in b.to_pylist():
                if walk is None or block != (u["img"], u["block"]):
                    if walk is not None:
                        out += left(block, walk)
                    block, walk = (u["img"], u["block"]), Walk(u["entry"], Rules(**fields))
                walk.unit(u)
            yield table(out, kind)
        if walk is not None:
            yield table(left(block, walk), kind)

    # blocks lie along sorted partitions: a call for each of them would take longer than the rules
    rows = units.join(entries, ["img", "block"]).repartition("img", "block").sortWithinPartitions("img", "block", "at")
    return rows.mapInArrow(run, f"img {img}, {PIECES}")


def block_pieces(units: DataFrame, rules: Rules, span: int = SPAN) -> tuple[DataFrame, int]:
    """The pieces of all blocks, each entered as the one before is left; and the rounds that took."""
    order = preceding(units.groupBy("img", "block").count().withColumn("place", F.col("block")), "img", "block", "place", max(1, span)).select("img", "block", F.col("last_place").alias("before"))
    order = written(order)
    states = order.select("img", "block", "before", F.lit(None).cast("string").alias("entry"))
    todo, tables, latest, rounds = states.select("img", "block", "entry"), [], None, 0
    while True:
        rounds += 1
        made = written(walked(units, todo, rules).withColumn("round", F.lit(rounds)))
        tables.append(made)
        exits = made.where("kind = 'exit'").select("img", "block", F.col("exit").alias("_exit"), "round")
        new = todo.select("img", "block", F.col("entry").alias("_entry")).join(exits, ["img", "block"])
        if latest is None:
            latest = written(new)
        else:
            old, latest = latest, written(latest.join(new.select("img", "block"), ["img", "block"], "left_anti").unionByName(new))
            removed(old)
        left = latest.select("img", F.col("block").alias("before"), F.col("_exit").alias("entry"))
        due = order.join(left, ["img", "before"], "left").select("img", "block", "entry")
        todo = written(due.join(latest.select("img", "block", "_entry"), ["img", "block"]).where("not (entry <=> _entry)").select("img", "block", "entry"))
        if todo.isEmpty():
            break
    pieces = tables[0]
    for t in tables[1:]:
        pieces = pieces.unionByName(t)
    return pieces.join(latest.select("img", "block", "round"), ["img", "block", "round"]).where("kind <> 'exit'"), rounds


def carve(chunks: DataFrame, rules: Rules = Rules(), block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(img, kind, codec, extents, units, pictures, random_access, reason): the clips and orphans of each image.

    kind is 'clip' or 'orphan'; several extents where fragments were joined (rules.join_gap). An image is a row of chunks
    of any size (spanloom.sources.images, overlap RAW or more); images without units give no rows. Columns of chunks other
    than img, pos, data, before and after are not looked at.
    """
    units = written(described(nal_units(chunks, span)).withColumn("block", F.floor(F.col("at") / block)))
    pieces, _ = block_pieces(units, rules, max(1, span // block))
    return stitched(written(pieces), max(1, span // block))


def stitched(pieces: DataFrame, span: int) -> DataFrame:
    """Pieces of one clip or orphan put together, by the position where it opened."""
    opened = F.when(F.col("opens"), F.col("s")[0])
    still = pieces.where("not closes and opens").groupBy("img", "block", "kind").agg(F.max("s").alias("s")).select("img", "block", "kind", F.col("s")[0].alias("start"))
    out = None
    for kind in ("clip", "orphan"):
        own = pieces.where(F.col("kind") == kind)
        # a block can hand on one clip at most: one that it opened, or one that it was handed
        line = own.where("not opens").select("img", "block", F.lit(True).alias("asks")).unionByName(still.where(F.col("kind") == kind).select("img", "block", F.lit(False).alias("asks"))).groupBy("img", "block").agg(F.bool_or("asks").alias("asks"))
        line = line.join(still.where(F.col("kind") == kind).drop("kind"), ["img", "block"], "left")
        handed = preceding(line, "img", "block", "start", span).where("asks").select("img", "block", F.col("last_start").alias("handed"))
        one = own.join(handed, ["img", "block"], "left").withColumn("start", F.coalesce(opened, "handed"))
        out = one if out is None else out.unionByName(one)
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "s", "e")))
    g = out.groupBy("img", "kind", "start").agg(F.min_by("codec", "block").alias("codec"), parts.alias("parts"), F.sum("units").alias("units"), F.sum("pictures").alias("pictures"), F.sum("access").alias("random_access"), F.coalesce(F.max("reason"), F.lit("end of image")).alias("reason"))
    pairs = F.flatten(F.transform("parts", lambda p: F.transform(p["s"], lambda x, k: F.struct(x.alias("s"), F.get(p["e"], k).alias("e")))))
    return g.select("img", "kind", "codec", F.aggregate(pairs, F.array().cast("array<struct<s: bigint, e: bigint>>"), extended).alias("extents"), "units", "pictures", "random_access", "reason")


def extended(extents: Column, piece: Column) -> Column:
    """The extents and a piece: one without a start goes on with the last extent."""
    last = F.element_at(extents, -1)
    longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], piece["e"]).alias("e"))
    return F.when(piece["s"].isNotNull(), F.concat(extents, F.array(piece))).when(piece["e"].isNull(), extents).otherwise(F.concat(F.slice(extents, 1, F.size(extents) - 1), F.array(longer)))
