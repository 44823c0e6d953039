"""Token counts of the sections of a text.

Each whole text is encoded once. Its tokens are intervals of bytes, its sections (lines by default) are intervals of
bytes too, and the two are joined: a token inside one section counts there; a token that crosses a boundary is
allocated by an explicit rule:

* "first": to the section that holds its first byte,
* "last": to the section that holds its last byte,
* "most": to the section that holds most of its bytes, the first of equals.

A separator belongs to the section that it ends, so the sections cover the text and the counts of a text's sections
add up to its tokens. Defined results: a null or empty text has one empty section without tokens; repeated rows give
repeated rows. Section bounds are given in code points. A text of any length is encoded whole; an empty table gives no
rows; other columns, however named, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks, vocabulary_of
from .common import bounded_batches, id_text, sha256

RULES = ("first", "last", "most")

_encoders: dict[tuple, tuple[tiktoken.Encoding, np.ndarray]] = {}


def _encoder(vocabulary: Broadcast, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The library's encoder and each token's length in bytes, once a worker."""
    key = (sha256(vocabulary.value), pattern)
    if key not in _encoders:
        ranks = read_ranks(vocabulary.value)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(w) for w in ranks]
        _encoders[key] = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[key]


def section_starts(data: bytes, separator: bytes) -> np.ndarray:
    """Where sections begin: at 0 and after each separator that isn't at the end."""
    starts, at = [0], data.find(separator)
    while at >= 0 and at + len(separator) < len(data):
        starts.append(at + len(separator))
        at = data.find(separator, at + len(separator))
    return np.array(starts, np.int64)


def allocate(token_lengths: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens allocated) of each section."""
    ends = np.cumsum(token_lengths)
    begins = ends - token_lengths
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    to = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for t in crossing:
            edges = np.concatenate(([begins[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]))
            to[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


SECTIONS = "array<struct<section:int,start:long,end:long,n_tokens:long,n_crossing:long>>"


def section_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, separator: str = "\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each section of each text."""
    if rule not in RULES or not separator:
        raise ValueError(f"rule is one of {RULES}, separator not empty")
    bounded_batches(docs.sparkSession)
    vocabulary, mark = vocabulary_of(docs, vocabulary_path), separator.encode()
    fields = ["section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(vocabulary, pattern)
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in fields]
            sizes = []
            for text in b.column("text").to_pylist():
                text = text or ""
                data = text.encode("utf-8", "replace")
                starts = section_starts(data, mark)
                own, crossing = allocate(lengths[encoder.encode_ordinary(text)], starts, rule)
                bounds = np.append(starts, len(data))
                if len(data) != len(text):  # bytes to code points
                    heads = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                    bounds = heads[bounds]
                sizes.append(len(starts))
                for c, v in zip(columns, (np.arange(len(starts)), bounds[:-1], bounds[1:], own, crossing)):
                    c.append(v)
            whole = [np.concatenate(c) for c in columns]
            arrays = [pa.array(v, pa.int32() if k == 0 else pa.int64()) for k, v in enumerate(whole)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            nested = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), nested], ["doc_id", "sections"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, sections {SECTIONS}").select("doc_id", F.inline("sections"))


def text_tokens(sections: DataFrame) -> DataFrame:
    """Tokens, sections and boundary-crossing tokens of each text."""
    return sections.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_sections"), F.sum("n_crossing").alias("n_crossing"), F.max("n_tokens").alias("most_in_a_section"))
