"""Codec headers read bit by bit, a whole Arrow batch at a time: one cursor a row, damaged rows drop out of a mask.

A field beyond the end of its row, a number of more than 32 leading zeros or a value out of its range makes the row
unreadable (null in the results); it never raises. Strict validity follows the syntax order and ranges of the standards'
parameter sets up to the optional video usability part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import sliced

#: Fixed values of the two standards.
HIGH_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244)
H264_PROFILES = (66, 77, 88, *HIGH_PROFILES)
H264_LEVELS = (9, 10, 11, 12, 13, 20, 21, 22, 30, 31, 32, 40, 41, 42, 50, 51, 52, 60, 61, 62)
H265_LEVELS = (30, 60, 63, 90, 93, 120, 123, 150, 153, 156, 180, 183, 186)
MOST_MACROBLOCKS = 139264
#: Bits after a slice's picture parameter set id that can hold its frame number: 2 of a colour plane and 16.
TAIL = 18


class Bits:
    """Cursors over byte strings; `skip` header bytes are left out and emulation-prevention bytes taken out first."""

    def __init__(self, rows: list[bytes], skip: int) -> None:
        bodies = [r[skip:].replace(b"\0\0\3", b"\0\0") for r in rows]
        lengths = np.array([len(x) for x in bodies], np.int64)
        self.base = np.concatenate(([0], np.cumsum(lengths + 8)))[:-1]
        self.flat = np.frombuffer(b"".join(x + bytes(8) for x in bodies), np.uint8)
        self.size, self.at = lengths * 8, np.zeros(len(rows), np.int64)
        self.ok = np.ones(len(rows), bool)

    def _window(self) -> np.ndarray:
        """The 57 bits or more from each cursor on, at the top of 64."""
        first = self.base + np.minimum(self.at, self.size) // 8
        out = np.zeros(len(first), np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | self.flat[np.minimum(first + k, len(self.flat) - 1)].astype(np.uint64)
        return out << (self.at % 8).astype(np.uint64)

    def _rows(self, when: np.ndarray | None, width: np.ndarray) -> np.ndarray:
        rows = self.ok if when is None else self.ok & when
        short = rows & (self.at + width > self.size)
        self.ok = self.ok & ~short
        return rows & ~short

    def u(self, n: int | np.ndarray, when: np.ndarray | None = None) -> np.ndarray:
        """n bits, 57 at most, as a number; 0 in rows left out."""
        width = np.broadcast_to(np.asarray(n, np.int64), self.at.shape)
        rows = self._rows(when, width)
        value = np.where(width > 0, self._window() >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)
        self.at = self.at + np.where(rows, width, 0)
        return np.where(rows, value, 0)

    def skip(self, n: int) -> None:
        self.at = self.at + np.where(self._rows(None, np.full(self.at.shape, n)), n, 0)

    def ue(self, when: np.ndarray | None = None) -> np.ndarray:
        """An unsigned Exp-Golomb number."""
        rows = self.ok if when is None else self.ok & when
        top = (self._window() >> np.uint64(24)).astype(np.float64)  # 40 bits, exact
        zeros = 40 - np.frexp(top)[1].astype(np.int64)
        bad = rows & ((top == 0) | (zeros > 32))
        self.ok = self.ok & ~bad
        zeros = np.where(rows & ~bad, zeros, 0)
        self.at = self.at + np.where(self._rows(when, zeros + 1), zeros + 1, 0)
        rest = self.u(zeros, when)
        return np.where(self.ok & (rows if when is None else rows & when), (np.int64(1) << zeros) - 1 + rest, 0)

    def se(self, when: np.ndarray | None = None) -> np.ndarray:
        k = self.ue(when)
        return np.where(k % 2 == 1, (k + 1) // 2, -(k // 2))

    def scaling_list(self, size: int, when: np.ndarray) -> None:
        last, following = np.full(len(self.at), 8), np.full(len(self.at), 8)
        for _ in range(size):
            more = when & (following != 0)
            if not more.any():
                return
            following = np.where(more, (last + self.se(more) + 256) % 256, following)
            last = np.where(following == 0, last, following)


Fields = dict[str, np.ndarray]


def h264_sps(rows: list[bytes]) -> Fields:
    """read, valid, profile, id, frame_num_bits, separate_planes, width, height (in macroblocks)."""
    r = Bits(rows, 1)
    profile, constraints, level = r.u(8), r.u(8), r.u(8)
    good = np.isin(profile, H264_PROFILES) & (constraints & 3 == 0) & np.isin(level, H264_LEVELS)
    own = r.ue()
    high = np.isin(profile, HIGH_PROFILES)
    chroma = r.ue(high)
    separate = r.u(1, high & (chroma == 3))
    luma, colour = r.ue(high), r.ue(high)
    good &= (chroma <= 3) & (luma <= 6) & (colour <= 6)
    r.u(1, high)
    scaled = high & (r.u(1, high) == 1)
    for k in range(12 if scaled.any() else 0):
        some = scaled & ((chroma == 3) | (k < 8))
        r.scaling_list(16 if k < 6 else 64, some & (r.u(1, some) == 1))
    width = r.ue() + 4
    read = r.ok & (own <= 31) & (width <= 16)
    order = r.ue()
    good &= order <= 2
    good &= r.ue(order == 0) <= 12
    cyclic = order == 1
    r.u(1, cyclic)
    r.se(cyclic)
    r.se(cyclic)
    cycle = r.ue(cyclic)
    good &= cycle <= 255
    for k in range(int(np.where(good & r.ok, cycle, 0).max(initial=0))):
        r.se(cyclic & good & (k < cycle))
    good &= r.ue() <= 16
    r.u(1)
    across, down = r.ue() + 1, r.ue() + 1
    good &= (across <= 1024) & (down <= 1024)
    r.u(1, r.u(1) == 0)
    r.u(1)
    cropped = r.u(1) == 1
    for _ in range(4):
        good &= r.ue(cropped) <= 8192
    return {"read": read, "valid": read & r.ok & good, "profile": profile, "id": own, "frame_num_bits": width, "separate_planes": separate, "width": across, "height": down}


def h264_pps(rows: list[bytes]) -> Fields:
    """read, valid, id, refers (to a sequence parameter set)."""
    r = Bits(rows, 1)
    own = r.ue()
    read = r.ok & (own <= 255)
    refers = r.ue()
    r.u(2)
    good = r.ue() <= 7
    good &= r.ue() <= 31
    good &= r.ue() <= 31
    r.u(1)
    good &= r.u(2) <= 2
    qp = r.se()
    good &= (qp >= -26) & (qp <= 25)
    r.se()
    good &= np.abs(r.se()) <= 12
    return {"read": read, "valid": read & r.ok & good, "id": own, "refers": refers}


def h265_vps(rows: list[bytes]) -> Fields:
    r = Bits(rows, 2)
    own = r.u(4)
    r.u(8)
    good = r.u(3) <= 6
    r.u(1)
    good &= r.u(16) == 0xFFFF
    return {"read": r.ok.copy(), "valid": r.ok & good, "id": own}


def h265_sps(rows: list[bytes]) -> Fields:
    """id is -1 where sub-layers follow, whose syntax isn't read; refers is the video parameter set's id."""
    r = Bits(rows, 2)
    refers, layers = r.u(4), r.u(3)
    r.u(1)
    good = (layers <= 6) & (r.u(2) == 0)
    r.u(1)
    profile = r.u(5)
    good &= (profile >= 1) & (profile <= 11)
    r.skip(80)
    good &= np.isin(r.u(8), H265_LEVELS)
    plain = layers == 0
    own, chroma = r.ue(plain), r.ue(plain)
    r.u(1, plain & (chroma == 3))
    width, height = r.ue(plain), r.ue(plain)
    good &= ~plain | ((own <= 15) & (chroma <= 3) & (width >= 8) & (width <= 16384) & (height >= 8) & (height <= 16384))
    return {"read": r.ok.copy(), "valid": r.ok & good, "id": np.where(plain, own, -1), "refers": refers, "width": width, "height": height}


def h265_pps(rows: list[bytes]) -> Fields:
    r = Bits(rows, 2)
    own = r.ue()
    read = r.ok & (own <= 63)
    refers = r.ue()
    good = refers <= 15
    r.u(7)
    good &= r.ue() <= 14
    good &= r.ue() <= 14
    qp = r.se()
    good &= (qp >= -38) & (qp <= 25)
    r.u(3)
    return {"read": read, "valid": read & r.ok & good, "id": own, "refers": refers}


def h264_slice(rows: list[bytes]) -> Fields:
    """read, kind, pps, and the next bits (TAIL at most, as many as there are), in which the frame number lies."""
    r = Bits(rows, 1)
    first, kind, pps = r.ue(), r.ue(), r.ue()
    read = r.ok & (first <= MOST_MACROBLOCKS) & (kind <= 9) & (pps <= 255)
    left = np.clip(r.size - r.at, 0, TAIL)
    return {"read": read, "kind": kind, "pps": pps, "tail": r.u(left), "tail_bits": left}


def h265_slice(rows: list[bytes], kinds: np.ndarray) -> Fields:
    """read and pps of slices of NAL types `kinds`."""
    r = Bits(rows, 2)
    r.u(1)
    r.u(1, (kinds >= 16) & (kinds <= 23))
    pps = r.ue()
    return {"read": r.ok & (pps <= 63), "pps": pps}


def frame_number(tail: int, bits: int, width: int, separate: int) -> int | None:
    """The frame number in the bits after a slice's pps id; None where they are too few."""
    rest = bits - 2 * separate - width
    return None if rest < 0 else tail >> rest & (1 << width) - 1


#: What parameter_sets returns: null where a set isn't read.
PARAMETER = "struct<valid: boolean, id: int, refers: int, profile: int, frame_num_bits: int, separate_planes: int, width: int, height: int>"
READERS = {("h264", "sps"): h264_sps, ("h264", "pps"): h264_pps, ("h265", "vps"): h265_vps, ("h265", "sps"): h265_sps, ("h265", "pps"): h265_pps}
NAMES = ["id", "refers", "profile", "frame_num_bits", "separate_planes", "width", "height"]


def read_parameters(codec: list[str | None], part: list[str | None], raw: list[bytes | None]) -> list[dict | None]:
    """A PARAMETER for each parameter set; None for what is none or can't be read."""
    out: list[dict | None] = [None] * len(raw)
    for key, reader in READERS.items():
        at = [k for k, x in enumerate(raw) if x is not None and (codec[k], part[k]) == key]
        if at:
            f = reader([raw[k] for k in at])
            for j, k in enumerate(at):
                if f["read"][j]:
                    out[k] = {"valid": bool(f["valid"][j])} | {n: int(f[n][j]) if n in f else None for n in NAMES}
    return out


def parameter_sets(units: DataFrame, raw_col: str = "raw", codec_col: str = "codec", part_col: str = "part") -> DataFrame:
    """units with a column `parameter`: the fields of each H.264 or H.265 parameter set (NAL bytes from the header on).

    A column of that name in units is replaced.
    """
    units = units.drop("parameter")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("valid", pa.bool_()), *((n, pa.int32()) for n in NAMES)]
        for b in sliced(batches):
            found = read_parameters(*(b.column(c).to_pylist() for c in (codec_col, part_col, raw_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.struct(fields))], [*b.schema.names, "parameter"])

    return units.mapInArrow(run, f"{kinds}, parameter {PARAMETER}")


def slices(units: DataFrame, raw_col: str = "head", codec_col: str = "codec", type_col: str = "type") -> DataFrame:
    """units with `kind` and `pps` of their slice headers (kind only for H.264); null where a header can't be read.

    Columns of these names in units are replaced.
    """
    units = units.drop("kind", "pps")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            codec, types, raw = (b.column(c).to_pylist() for c in (codec_col, type_col, raw_col))
            kind: list[int | None] = [None] * len(raw)
            pps: list[int | None] = [None] * len(raw)
            for name in ("h264", "h265"):
                at = [k for k, x in enumerate(raw) if x is not None and codec[k] == name]
                if at:
                    rows = [raw[k] for k in at]
                    f = h264_slice(rows) if name == "h264" else h265_slice(rows, np.array([types[k] or 0 for k in at]))
                    for j, k in enumerate(at):
                        if f["read"][j]:
                            pps[k] = int(f["pps"][j])
                            kind[k] = int(f["kind"][j]) if name == "h264" else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind, pa.int32()), pa.array(pps, pa.int32())], [*b.schema.names, "kind", "pps"])

    return units.mapInArrow(run, f"{kinds}, kind int, pps int")

