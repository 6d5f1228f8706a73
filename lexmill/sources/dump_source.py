"""Multistream dumps as a data source: partitions planned from the index, streams unpacked piece by piece, and a streaming form that goes on where it stopped.

``spark.read.format("multistream_dump").option("path", dump).option("index", index)``, after ``register``. Both are addresses that every executor can open (a shared
folder, or a store that pyarrow knows). What is planned in one place is one number a stream, never the entries.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lexmill.sources.dumps import PAGE, with_redirect

#: A bzip2 stream begins with these, the level behind them. Fixed value.
MAGIC = b"BZh"
_PIECE = 1 << 20
_BATCH_PAGES, _BATCH_CHARS = 1000, 8 << 20
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
_NAMES = [c.split()[0] for c in PAGE.split(", ")]


def _open(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def _lines(uri: str) -> Iterator[bytes]:
    """Lines of a plain or bz2 file, piece by piece."""
    with _open(uri) as f:
        packed = f.read(3) == MAGIC
        f.seek(0)
        unpack, rest = bz2.BZ2Decompressor(), b""
        while data := f.read(_PIECE):
            while data:
                piece, data = (unpack.decompress(data), b"") if packed else (data, b"")
                if packed and unpack.eof:
                    data, unpack = unpack.unused_data, bz2.BZ2Decompressor()
                *whole, rest = (rest + piece).split(b"\n")
                yield from whole
        if rest:
            yield rest


def plan(index: str, dump: str, checked: int = 32) -> list[int]:
    """The offsets of all streams, in order. An error says what is wrong: a line that is no entry, an offset below the one before, one behind the dump's end, or one
    of the first ``checked`` at which no stream begins."""
    offsets: list[int] = []
    for line in _lines(index):
        if not line.strip():
            continue
        at, _, rest = line.partition(b":")
        if not at.isdigit() or not rest.partition(b":")[0].isdigit():
            raise ValueError(f"not an index line: {line[:200].decode(errors='replace')}")
        offset = int(at)
        if offsets and offset < offsets[-1]:
            raise ValueError(f"offset {offset} is below the one before, {offsets[-1]}")
        if not offsets or offset != offsets[-1]:
            offsets.append(offset)
    with _open(dump) as f:
        size = f.size()
        if offsets and offsets[-1] >= size:
            raise ValueError(f"offset {offsets[-1]} is behind the end of the dump, {size}")
        for offset in offsets[:checked]:
            f.seek(offset)
            if f.read(3) != MAGIC:
                raise ValueError(f"no stream begins at {offset}")
    return offsets


def pages_at(f, offset: int) -> Iterator[tuple]:
    """Pages of the stream at an offset, each as soon as it is complete; neither the packed nor the unpacked stream is held as a whole. A cut stream is an error."""
    f.seek(offset)
    unpack, parser = bz2.BZ2Decompressor(), ElementTree.XMLPullParser(["start", "end"])
    parser.feed("<pages>")
    root = None
    while not unpack.eof:
        data = f.read(_PIECE)
        if not data:
            raise EOFError(f"the stream at {offset} is cut")
        while data or not (unpack.needs_input or unpack.eof):
            piece, data = unpack.decompress(data, max_length=_PIECE), b""
            parser.feed(piece)
            for event, element in parser.read_events():
                if root is None:
                    root = element
                elif event == "end" and element.tag == "page":
                    revision = element.find("revision")
                    if revision is not None:
                        number = lambda v: int(v) if v else None
                        redirect = element.find("redirect")
                        yield (
                            number(element.findtext("id")), element.findtext("title"), number(element.findtext("ns")), None if redirect is None else redirect.get("title"),
                            number(revision.findtext("id")), revision.findtext("timestamp"), revision.findtext("text") or "",
                        )
                    root.clear()


@dataclass
class Streams(InputPartition):
    offsets: tuple[int, ...]


class _Reading:
    def __init__(self, options: dict):
        if not options.get("path") or not options.get("index"):
            raise ValueError("a dump needs the options path and index")
        self.dump, self.index = options["path"], options["index"]
        self.each = int(options.get("streams", "16"))

    def _dealt(self, offsets: list[int]) -> list[Streams]:
        return [Streams(tuple(offsets[k : k + self.each])) for k in range(0, len(offsets), self.each)]

    def _batches(self, partition: Streams) -> Iterator[pa.RecordBatch]:
        with _open(self.dump) as f:
            rows, chars = [], 0
            for offset in partition.offsets:
                for row in pages_at(f, offset):
                    rows.append(row)
                    chars += len(row[-1])
                    if len(rows) >= _BATCH_PAGES or chars >= _BATCH_CHARS:
                        yield _batch(rows)
                        rows, chars = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES)


class DumpReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Streams]:
        return self._dealt(plan(self.index, self.dump)) or [Streams(())]

    def read(self, partition: Streams) -> Iterator[pa.RecordBatch]:
        yield from self._batches(partition)


class DumpStreamReader(_Reading, DataSourceStreamReader):
    """An offset is the number of streams that the index names: a dump that grows, its index with it, gives each batch what is new."""

    def initialOffset(self) -> dict:
        return {"streams": 0}

    def latestOffset(self) -> dict:
        return {"streams": len(plan(self.index, self.dump, 0))}

    def partitions(self, start: dict, end: dict) -> list[Streams]:
        return self._dealt(plan(self.index, self.dump, 0)[start["streams"] : end["streams"]])

    def read(self, partition: Streams) -> Iterator[tuple]:
        for batch in self._batches(partition):
            yield from zip(*(c.to_pylist() for c in batch.columns))


class DumpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream_dump"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DumpReader:  # noqa: ANN001
        return DumpReader(self.options)

    def streamReader(self, schema) -> DumpStreamReader:  # noqa: ANN001
        return DumpStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DumpSource)


def read_dump(spark: SparkSession, dump: str, index: str, streams: int = 16) -> DataFrame:
    """Pages of a dump, a partition for so many streams; a page's redirect is its element's, or else the one that its text names."""
    register(spark)
    return with_redirect(spark.read.format("multistream_dump").option("path", dump).option("index", index).option("streams", str(streams)).load())


def stream_dump(spark: SparkSession, dump: str, index: str, streams: int = 16) -> DataFrame:
    """The same as a stream: with a checkpoint, a query that is started again reads only streams that it has not read."""
    register(spark)
    return with_redirect(spark.readStream.format("multistream_dump").option("path", dump).option("index", index).option("streams", str(streams)).load())
