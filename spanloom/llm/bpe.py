"""Byte-level BPE by prefix dynamic programming.

A byte string's encoding is unique, so each of its prefixes has one last token. `PrefixCoder.extend` finds it for every
prefix in turn: the token t ending there whose predecessor, the last token of the prefix before t, may stand next to t
(a pair that BPE itself would leave as it is). The table of last tokens makes appending exact (old entries never
change) and confines an edit to the entries from the edit on, until they agree with the old ones for as many positions
as the longest token has bytes.

The vocabulary file is of fixed size, so its bytes are broadcast from the driver; executors need no such file.

Defined results: a null text is empty; an empty text has no tokens; repeated rows give repeated rows; lone surrogates
become U+FFFD as in the tiktoken library; a text of any length is encoded whole; an empty table gives no rows; other
columns, however named, are not looked at.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import bounded_batches, id_text, sha256

#: Pieces and token pairs a worker remembers; beyond, it starts anew.
CACHE_ENTRIES = 600_000


def read_ranks(file: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


class PrefixCoder:
    """Encoding of byte strings (pieces) by their prefixes' last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.shift = len(self.words).bit_length()
        self.prefixes = {w[:k]: -1 for w in ranks for k in range(1, len(w))} | ranks

    def _merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """By the definition: merge the leftmost pair of lowest rank while there is one and over `until` parts. For single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            at = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(at)
            if low == 1 << 60:
                break
            k = at.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a followed by token b as they are."""
        key = a << self.shift | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = not self._crossed(a, b)
        return known

    def _edge(self, t: int, side: int) -> list[tuple[bytes, int, int]]:
        """The nodes on one edge of token t's merge tree: bytes, rank when formed, rank when merged into the next."""
        known = self.edges.get((t, side))
        if known is None:
            node, until, known = self.words[t], 1 << 60, []
            while True:
                single = len(node) == 1
                formed = -1 if single else self.ranks[node]
                known.append((node, formed, until))
                if single:
                    break
                node, until = self._merged(node, 2)[side], formed
            self.edges[t, side] = known
        return known

    def _crossed(self, a: int, b: int) -> bool:
        """Whether some merge joins the end of a to the start of b before both are whole. At equal rank the left merge is first."""
        for x, x_formed, x_until in self._edge(a, 1):
            for y, y_formed, y_until in self._edge(b, 0):
                rank = self.ranks.get(x + y)
                if rank is not None and max(rank, y_formed) < x_until and max(rank, x_formed) <= y_until:
                    return True
        return False

    def alone(self, t: int) -> bool:
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = len(self._merged(self.words[t])) == 1
        return known

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill last[i], the last token of data[:i], for i from len(last) up to `stop`; last[0] stands for none.

        Runs over the positions where a token may begin and, from each, along the vocabulary's prefixes.
        """
        step, pairs, shift = self.prefixes.get, self.pairs, self.shift
        known = max(1, len(last))
        stop = len(data) if stop is None else stop
        last[len(last) :] = [-1] * (stop + 1 - len(last))
        for begin in range(max(0, known - self.longest), stop):
            before = last[begin]
            if begin == 0:
                before = -1
            elif before < 0:
                raise ValueError(f"no token ends at byte {begin}; the vocabulary lacks a byte")
            else:
                before <<= shift
            end = begin
            while end < stop:
                end += 1
                token = step(data[begin:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0 and end >= known:
                    fits = self.alone(token) if before < 0 else pairs.get(before | token)
                    if fits is None:
                        fits = self.adjacent(last[begin], token)
                    if fits:
                        last[end] = token
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens, from the last one back."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.words[last[at]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        known = self.ranks.get(data)
        if known is not None and self.alone(known):
            return [known]
        return self.walk(self.extend(data, []))

    def edit(self, data: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[begin:end] by `new`: entries up to `begin` stay; those after the edit are recomputed until `longest` in a row agree."""
        edited = data[:begin] + new + data[end:]
        shift = len(new) - (end - begin)
        table, same = last[: begin + 1], 0  # an entry depends on nothing beyond it
        for at in range(begin + 1, len(edited) + 1):
            self.extend(edited, table, at)
            same = same + 1 if at > begin + len(new) and table[at] == last[at - shift] else 0
            if same >= self.longest:
                return edited, table + last[at + 1 - shift :]
        return edited, table


class TextCoder:
    """Whole texts: each match of the pattern is a piece of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.coder, self.pattern = PrefixCoder(ranks), regex.compile(pattern)
        self.packed: dict[str, bytes] = {}
        self.words = np.array(self.coder.words, object)

    def piece(self, piece: str) -> bytes:
        if len(self.packed) >= CACHE_ENTRIES:
            self.packed.clear()
        ids = self.coder.encode(piece.encode("utf-8", "replace"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self.packed[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text.isascii():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        known = self.packed.get
        return b"".join([known(p) or self.piece(p) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(self.words[np.frombuffer(packed, "<u4")].tolist())

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """encode(text + more) from encode(text): all but the last pieces stay.

        A match depends on at most two characters beyond it, so the last three pieces are matched again.
        """
        starts = [m.start() for m in self.pattern.finditer(text)]
        if len(starts) < 4:
            return self.encode(text + more)
        cut = starts[-3]
        kept, size, need = 0, 0, len(text[:cut].encode())
        while size < need:
            size += len(self.coder.words[ids[kept]])
            kept += 1
        return ids[:kept] + self.encode(text[cut:] + more)


#: A vocabulary file is smaller than this.
MOST_BYTES = 64 << 20

_coders: dict[tuple, TextCoder] = {}


def worker_coder(vocabulary: Broadcast, pattern: str) -> TextCoder:
    """The worker's coder, which outlives a task."""
    key = (sha256(vocabulary.value), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = TextCoder(read_ranks(vocabulary.value), pattern)
    return _coders[key]


def vocabulary_of(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file's bytes on every executor; one of MOST_BYTES or more is refused."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES)
    if len(data) == MOST_BYTES:
        raise ValueError(f"{path} has {MOST_BYTES} bytes or more: too large to be a vocabulary")
    return df.sparkSession.sparkContext.broadcast(data)


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each whole text's token ids, packed as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    vocabulary = vocabulary_of(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(vocabulary, pattern)
        for b in batches:
            ids = [coder.encode_packed(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


DECODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def decode_digests(encoded: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Decodes the ids of `encode` and returns digests of the ids and of the decoded bytes."""
    bounded_batches(encoded.sparkSession)
    vocabulary = vocabulary_of(encoded, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(vocabulary, pattern)
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_tokens"), pa.array([sha256(x) for x in ids]), pa.array([sha256(coder.decode_packed(x)) for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
