"""A data source for images on failing media: chunks with their neighbours' edges, read again after errors, sector by sector where
a chunk can't be read, zeros and a list of bad ranges where a sector can't.

    spark.dataSource.register(ImageSource)
    spark.read.format("spanloom_image").option("path", ...).option("chunk", 1 << 20).load()

Each partition reads a stretch of the image by itself, with `overlap` bytes more on both sides, so that no chunks are joined
for their edges. A task that runs again reads the same bytes. With `only` (offsets of chunks, parted by commas, as of
spanloom.sources.images.to_fetch) a resumed acquisition reads what it lacks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Read = Callable[[int, int], bytes]
SCHEMA = "img string, pos long, data binary, before binary, after binary, bad array<struct<s: bigint, e: bigint, error: string>>"


class SourceChanged(OSError):
    """The source is shorter than it said."""


def retried(read: Read, at: int, n: int, retries: int) -> bytes:
    for left in range(retries, -1, -1):
        try:
            data = read(at, n)
            break
        except SourceChanged:
            raise
        except OSError:
            if not left:
                raise
    if len(data) != n:
        raise SourceChanged(f"{len(data)} bytes of {n} at {at}")
    return data


def read_through(read: Read, at: int, n: int, retries: int, sector: int) -> tuple[bytes, list[tuple[int, int, str]]]:
    """n bytes at a place, zeros where a sector can't be read, and the bad ranges; neighbours of one error are one range."""
    try:
        return retried(read, at, n, retries), []
    except SourceChanged:
        raise
    except OSError:
        pass
    out, bad = bytearray(), []
    for s in range(at, at + n, sector):
        m = min(sector, at + n - s)
        try:
            out += retried(read, s, m, retries)
        except SourceChanged:
            raise
        except OSError as error:
            said = error.strerror or type(error).__name__
            out += bytes(m)
            if bad and bad[-1][1] == s and bad[-1][2] == said:
                bad[-1] = (bad[-1][0], s + m, said)
            else:
                bad.append((s, s + m, said))
    return bytes(out), bad


class Stretch(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], opened: Callable[[str], tuple[int, Read]]) -> None:
        self.path, self.opened = options["path"], opened
        self.chunk, self.overlap = int(options.get("chunk", 1 << 20)), int(options.get("overlap", 64))
        self.retries, self.sector = int(options.get("retries", 1)), int(options.get("sector", 512))
        self.each = int(options.get("chunks_a_task", 64))
        self.only = {int(x) for x in options["only"].split(",") if x.strip()} if "only" in options else None
        self.name = options.get("name", os.path.basename(self.path))

    def partitions(self) -> list[Stretch]:
        size, _ = self.opened(self.path)
        step = self.chunk * self.each
        return [Stretch(s, min(size, s + step)) for s in range(0, size, step)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        size, read = self.opened(self.path)
        for pos in range(partition.first, partition.last, self.chunk):
            if self.only is not None and pos not in self.only:
                continue
            n = min(self.chunk, size - pos)
            data, bad = read_through(read, pos, n, self.retries, self.sector)
            lo, hi = max(0, pos - self.overlap), min(size, pos + n + self.overlap)
            before, _ = read_through(read, lo, pos - lo, self.retries, self.sector)
            after, _ = read_through(read, pos + n, hi - pos - n, self.retries, self.sector)
            yield self.name, pos, data, before, after, [{"s": s, "e": e, "error": x} for s, e, x in bad]


class ImageSource(DataSource):
    """Files and devices; another medium is a subclass with its own opened()."""

    @classmethod
    def name(cls) -> str:
        return "spanloom_image"

    def schema(self) -> str:
        return SCHEMA

    @staticmethod
    def opened(path: str) -> tuple[int, Read]:
        """The medium's size, and a function that reads bytes at a place."""
        f = open(path, "rb", buffering=0)  # noqa: SIM115  closed with the reader that holds it
        size = f.seek(0, os.SEEK_END)

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            out = b""
            while len(out) < n and (more := f.read(n - len(out))):
                out += more
            return out

        return size, read

    def reader(self, schema: object) -> ImageReader:
        return ImageReader(dict(self.options), self.opened)
