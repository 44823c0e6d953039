"""Media columns: baseline JPEG read in numpy.

`read_media` parses the markers of JPEG blobs, Huffman-decodes their scans and rebuilds a luminance thumbnail of one
pixel a block from the DC coefficients alone. The scans of all blobs of an Arrow batch are decoded in lockstep: a scan
is cut at its restart markers, each piece keeps its own bit position, and every numpy step reads one code of every
piece. `store_payloads` writes arbitrary bytes as a valid JPEG, a byte to a quantised coefficient (the format's unit),
which entropy coding keeps exactly.

Defined results: a null text is empty; an empty text becomes one block of zeros; a blob that is null or no readable
baseline JPEG gets null dimensions and an `error`; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, sha256

BLOCK = 64
#: Blocks a side that a frame of at most 65,535 pixels has.
MAX_SIDE = 8191
#: Quantiser of the DC coefficient in stored payloads: an 8-bit value then spans the thumbnail's grey range.
DC_STEP = 4


# ---- writing ---------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(table_class: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, whose code is the single bit 0."""
    return bytes([table_class << 4]) + bytes([1] + [0] * 15) + bytes([symbol])


def _header(width: int, height: int, payload_bytes: int) -> bytes:
    comment = b"payload=" + str(payload_bytes).encode()
    frame = struct.pack(">BHHB", 8, height * 8, width * 8, 1) + bytes([1, 0x11, 0])
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, comment),
        _segment(0xDB, bytes([0, DC_STEP] + [1] * 63)),
        _segment(0xC0, frame),
        _segment(0xC4, _one_code_table(0, 8) + _one_code_table(1, 8)),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def pad_payload(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each padded payload.

    Coefficients are taken from magnitude category 8 alone, whose 256 values stand for the 256 bytes; the only Huffman
    code is one bit, so a block is 64 * 9 bits, whole bytes. A restart marker after each block resets the DC
    prediction, so the DC coefficient holds its byte directly.
    """
    sides, blocks = [], []
    for p in payloads:
        n = len(p) // BLOCK
        width = math.isqrt(n - 1) + 1 if n <= MAX_SIDE**2 else 0
        if not width:
            raise ValueError(f"a payload of {len(p)} bytes is beyond a frame of {MAX_SIDE} x {MAX_SIDE} blocks")
        height = -(-n // width)
        sides.append((width, height))
        blocks.append(p + bytes((width * height - n) * BLOCK))
    if not payloads:
        return []
    data = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK)
    bits = np.zeros((len(data), BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data, axis=1).reshape(-1, BLOCK, 8)
    rows = np.empty((len(data), 74), np.uint8)
    rows[:, :72] = np.packbits(bits.reshape(len(data), -1), axis=1)
    counts = np.array([w * h for w, h in sides])
    first = np.repeat(np.cumsum(counts) - counts, counts)
    rows[:, 72] = 0xFF
    rows[:, 73] = 0xD0 + (np.arange(len(data)) - first) % 8
    stuffed = rows == 0xFF
    stuffed[:, 72] = False
    flat = rows.reshape(-1)
    ends = np.cumsum(1 + stuffed.reshape(-1).astype(np.int64))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - 1 - stuffed.reshape(-1)] = flat
    row_ends = ends.reshape(-1, 74)[:, -1]
    raw, result, start = out.tobytes(), [], 0
    for (w, h), p, last in zip(sides, payloads, np.cumsum(counts) - 1):
        end = int(row_ends[last])
        result.append(_header(w, h, len(p)) + raw[start : end - 2] + b"\xff\xd9")  # no restart marker after the last block
        start = end
    return result


# ---- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    blocks_w: int = 0
    blocks_h: int = 0


@dataclass
class Scan:
    order: list[tuple[int, int, int]]  # (component index, DC table, AC table), one for each component
    pieces: list[bytes]
    restart: int


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: list[bytes] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    error: str | None = None


def parse(blob: bytes) -> Frame:
    """The markers of one JPEG; `error` names what makes it unreadable."""
    frame, tables, restart = Frame(), {}, 0
    try:
        if blob[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at = 2
        while True:
            while blob[at] != 0xFF:
                raise ValueError("no marker where one is due")
            while blob[at + 1] == 0xFF:
                at += 1
            marker = blob[at + 1]
            if marker == 0xD9:
                break
            (length,) = struct.unpack_from(">H", blob, at + 2)
            body = blob[at + 4 : at + 2 + length]
            if len(body) != length - 2:
                raise ValueError("a segment is cut short")
            at += 2 + length
            if marker == 0xFE:
                frame.comment = body
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, ident = body[i] >> 4, body[i] & 15
                    size = 128 if wide else 64
                    frame.quant[ident] = np.frombuffer(body[i + 1 : i + 1 + size], ">u2" if wide else "u1").astype(np.int32)
                    i += 1 + size
            elif marker in (0xC0, 0xC1):
                depth, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not frame.height or not frame.width:
                    raise ValueError("not an 8-bit frame of known size")
                frame.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
                for c in frame.components:
                    c.blocks_w, c.blocks_h = -(-frame.width * c.h // (8 * h)), -(-frame.height * c.v // (8 * v))
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    tables[body[i]] = body[i + 1 : i + 17 + n]
                    i += 17 + n
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                order = []
                for k in range(body[0]):
                    c = next(j for j, x in enumerate(frame.components) if x.ident == body[1 + 2 * k])
                    dc, ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                    frame.tables += [tables[dc], tables[16 | ac]]
                    order.append((c, len(frame.tables) - 2, len(frame.tables) - 1))
                pieces, at = _entropy_pieces(blob, at)
                frame.scans.append(Scan(order, pieces, restart))
        if not frame.scans:
            raise ValueError("no scan")
    except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
        frame.error = str(e) or type(e).__name__
    return frame


def _entropy_pieces(blob: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded bytes from `at`, cut at restart markers and without stuffed zeros, and where they end."""
    data = np.frombuffer(blob, np.uint8)[at:]
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0))
    follow = data[marks + 1]
    ends = np.flatnonzero((follow < 0xD0) | (follow > 0xD7))
    if not len(ends):
        raise ValueError("the scan has no end")
    end, cuts = int(marks[ends[0]]), marks[: ends[0]]
    scan = blob[at : at + end]
    starts = [0, *(cuts + 2).tolist()]
    return [scan[s:e].replace(b"\xff\x00", b"\xff") for s, e in zip(starts, [*cuts.tolist(), end])], at + end


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the code's length (0 where there is none) and its symbol."""
    lengths, symbols = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            lengths[lo : lo + (1 << (16 - length))] = length
            symbols[lo : lo + (1 << (16 - length))] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


class _Lockstep:
    """Many entropy-coded pieces with the same MCU layout, read one code of each at a time."""

    def __init__(self, pieces: list[bytes], tables: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        gap = b"\xff" * 16  # so that a piece that ends early reads ones, not its neighbour
        raw = np.frombuffer(gap.join(pieces) + gap, np.uint8)
        starts = np.concatenate(([0], np.cumsum(sizes + 16)[:-1]))
        wide = np.zeros(len(raw), np.uint32)
        for k in range(4):
            wide[: len(raw) - k] |= raw[k:].astype(np.uint32) << np.uint32(24 - 8 * k)
        self.wide, self.at, self.end = wide, starts * 8, (starts + sizes) * 8
        looked = [_lookup(t) for t in tables]
        self.lengths, self.symbols = np.concatenate([x[0] for x in looked]), np.concatenate([x[1] for x in looked])
        self.bad = np.zeros(len(pieces), bool)

    def code(self, rows: np.ndarray | slice, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each row and the signed value that follows it."""
        at = self.at[rows]
        byte = np.minimum(at >> 3, len(self.wide) - 5)
        window = ((self.wide[byte].astype(np.uint64) << np.uint64(32)) | self.wide[byte + 4]) << (at & 7).astype(np.uint64)
        key = (window >> np.uint64(48)).astype(np.int64) + (tables << 16)
        length, symbol = self.lengths[key].astype(np.int64), self.symbols[key].astype(np.int64)
        size = symbol & 15
        bits = ((window << length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - size)
        value = np.where((bits >> np.maximum(size - 1, 0)) > 0, bits, bits - (1 << size) + 1)
        value[size == 0] = 0
        at = at + length + size
        self.bad[rows] |= (length == 0) | (at > self.end[rows])
        self.at[rows] = at
        return symbol, value

    def block(self, rows: np.ndarray, dc: np.ndarray, ac: np.ndarray, coefficients: np.ndarray | None, out: np.ndarray) -> np.ndarray:
        """One block of each row: the DC difference; the AC coefficients go to coefficients[out] in zigzag order."""
        _, diff = self.code(rows, dc)
        k = np.ones(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            all_live = len(live) == len(rows)
            symbol, value = self.code(rows if all_live else rows[live], ac if all_live else ac[live])
            run, size = symbol >> 4, symbol & 15
            skip = np.where(size > 0, run, np.where(run == 15, 15, 64))
            spot = k[live] + skip
            if coefficients is not None:
                hit = (size > 0) & (spot < BLOCK)
                coefficients[out[live[hit]], spot[hit]] = value[hit]
            k[live] = spot + 1
            self.bad[rows[live]] |= (size > 0) & (spot >= BLOCK)
            live = live[(spot + 1 < BLOCK) & ~self.bad[rows[live]]]
        return diff


def decode(blobs: list[bytes], coefficients: bool = False) -> list[tuple[Frame, np.ndarray | None, np.ndarray | None]]:
    """(frame, luminance DC by block row and column, coefficients of the first scan's blocks in coded order)."""
    frames = [parse(b) for b in blobs]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, f in enumerate(frames):
        for s, scan in enumerate([] if f.error else f.scans):
            if any(c == 0 for c, _, _ in scan.order):  # only scans with luminance matter to the thumbnail
                layout = tuple((c, 1, 1) if len(scan.order) == 1 else (c, f.components[c].h, f.components[c].v) for c, _, _ in scan.order)
                groups.setdefault((layout, scan.restart), []).append((i, s))
    result: list = [[f, None, None] for f in frames]
    for (layout, restart), members in groups.items():
        pieces, of, table_ids, known = [], [], [], {}
        schedule = [k for k, (_, h, v) in enumerate(layout) for _ in range(h * v)]
        for i, s in members:
            f, scan = frames[i], frames[i].scans[s]
            mcus = _mcus(f, scan)
            due = -(-mcus // restart) if restart else 1
            if len(scan.pieces) < due:
                f.error = "restart intervals are missing"
                continue
            ids = [tuple(known.setdefault(f.tables[t], len(known)) for t in (dc, ac)) for _, dc, ac in scan.order]
            for p in range(due):
                pieces.append(scan.pieces[p])
                of.append((i, s, min(restart, mcus - p * restart) if restart else mcus))
                table_ids.append(ids)
        if not pieces:
            continue
        reader = _Lockstep(pieces, list(known))
        n_mcu = np.array([x[2] for x in of], np.int64)
        per = len(schedule)
        base = np.concatenate(([0], np.cumsum(n_mcu * per)))
        tables = np.array(table_ids, np.int64)
        dc_out = np.zeros(int(base[-1]), np.int32)
        coef = np.zeros((int(base[-1]), BLOCK), np.int16) if coefficients else None
        predicted = np.zeros((len(pieces), len(layout)), np.int64)
        for t in range(int(n_mcu.max())):
            for j, k in enumerate(schedule):
                rows = np.flatnonzero((n_mcu > t) & ~reader.bad)
                if not len(rows):
                    break
                out = base[rows] + t * per + j
                predicted[rows, k] += reader.block(rows, tables[rows, k, 0], tables[rows, k, 1], coef, out)
                dc_out[out] = predicted[rows, k]
                if coef is not None:
                    coef[out, 0] = predicted[rows, k]
        owner = np.array([x[0] for x in of])
        for i, s in members:
            f = frames[i]
            mine = np.flatnonzero(owner == i) if len(members) < 64 else np.arange(*np.searchsorted(owner, [i, i + 1]))
            if f.error or not len(mine):
                continue
            if reader.bad[mine].any():
                f.error = "a code is not in its table or the scan is cut short"
                continue
            lo, hi = int(base[mine[0]]), int(base[mine[-1] + 1])
            result[i][1] = _luminance(f, layout, schedule, dc_out[lo:hi])
            result[i][2] = coef[lo:hi] if coef is not None else None
    return [tuple(x) for x in result]


def _mcus(f: Frame, scan: Scan) -> int:
    if len(scan.order) == 1:
        c = f.components[scan.order[0][0]]
        return c.blocks_w * c.blocks_h
    h, v = max(c.h for c in f.components), max(c.v for c in f.components)
    return -(-f.width // (8 * h)) * -(-f.height // (8 * v))


def _luminance(f: Frame, layout: tuple, schedule: list[int], dc: np.ndarray) -> np.ndarray:
    """DC coefficients of component 0 by block row and column."""
    c = f.components[0]
    k = next(j for j, x in enumerate(layout) if x[0] == 0)
    _, h, v = layout[k]
    if len(layout) == 1:
        return dc.reshape(c.blocks_h, c.blocks_w)
    wide = -(-f.width // (8 * max(x.h for x in f.components)))
    own = dc.reshape(-1, len(schedule))[:, [j for j, x in enumerate(schedule) if x == k]]
    grid = own.reshape(-1, wide, v, h).transpose(0, 2, 1, 3).reshape(-1, wide * h)
    return grid[: c.blocks_h, : c.blocks_w]


def thumbnail(f: Frame, dc: np.ndarray) -> np.ndarray:
    """Mean grey of each 8 x 8 block."""
    step = int(f.quant[f.components[0].quant][0])
    return np.clip(np.rint(dc * step / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 8 sampling is above their mean."""
    h, w = thumb.shape
    small = thumb[np.ix_(np.arange(8) * h // 8, np.arange(8) * w // 8)].astype(np.int64)
    return np.packbits((small * 64 > small.sum()).reshape(-1)).tobytes().hex()


def payload_of(f: Frame, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_payloads has stored."""
    flat = coefficients.reshape(-1)
    data = np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()
    return data[: int(f.comment.removeprefix(b"payload="))]


# ---- DataFrames ------------------------------------------------------------------------------------------------------

MEDIA = "doc_id long, n_bytes long, media binary"
THUMBNAILS = "doc_id long, width int, height int, thumb_width int, thumb_height int, thumb_sha256 string, average_hash string, thumbnail binary, error string"


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a JPEG."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            media = encode_payloads([pad_payload(r) for r in raw])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(run, MEDIA)


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions, DC-only luminance thumbnail and its hashes of each JPEG."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ident, (f, dc, _) in zip(b.column("doc_id").to_pylist(), decode([x or b"" for x in b.column("media").to_pylist()])):
                if f.error or dc is None:
                    rows.append((ident, None, None, None, None, None, None, None, f.error or "no luminance"))
                else:
                    t = thumbnail(f, dc)
                    rows.append((ident, f.width, f.height, t.shape[1], t.shape[0], sha256(t.tobytes()), average_hash(t), t.tobytes(), None))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
            names = [x.split()[0] for x in THUMBNAILS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, THUMBNAILS)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_payloads(media: DataFrame) -> DataFrame:
    """Of what store_payloads has stored: digests of the payload read back, and the thumbnail's features."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("media").to_pylist()
            rows = []
            for ident, n, blob, (f, dc, coef) in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), blobs, decode(blobs, True)):
                if f.error:
                    raise ValueError(f"stored media of {ident} can't be read: {f.error}")
                payload, t = payload_of(f, coef), thumbnail(f, dc)
                feature = f"{f.width}x{f.height}:{t.shape[1]}x{t.shape[0]}:{average_hash(t)}:{sha256(t.tobytes())}"
                rows.append((ident, n, len(payload), sha256(payload), zlib.crc32(payload[-BLOCK:]), len(blob), sha256(blob), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)
