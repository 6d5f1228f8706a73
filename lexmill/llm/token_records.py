"""Token ids in length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

A shard is two files. ``*.rec`` holds frames: length (u64), masked CRC-32 of those 8 bytes (u32), payload, masked CRC-32 of the
payload (u32); a payload is doc_id (i64), null flag (u8), bytes per id (u8) and the ids. ``*.idx`` holds every frame's offset and
the end (u64). All numbers are little-endian. Only files that the manifest names count: what a lost or repeated task attempt left
behind is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, texts_of

MANIFEST = "shard int, file string, records long, tokens long, bytes long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBB")
_encoders: dict[str, Encoder] = {}


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits, plus a constant: a checksum of data that itself holds checksums stays sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = _BODY.pack(doc_id or 0, doc_id is None, width) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((_HEAD.pack(len(payload), masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


class Remembered(dict):
    """Results of ``find``, thrown away when there are ``most``."""

    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.find(key)
        return found


class Encoder:
    """text -> ids as little-endian bytes, by the tokenizers library.

    Where the tokenizer's file says that white space ends every token (the settings below), a text's ids are those of its words, in
    order; words and the library's own pre-tokens are remembered, up to ``most`` of each. Any other tokenizer encodes whole texts.
    """

    #: The normalizers and the split pattern under which words can be encoded one by one, and the pattern for ASCII words in lower case.
    _NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.by_word = self._by_word(json.loads(self.tokenizer.to_str()))
        self.words, self.pieces = Remembered(self._word, most), Remembered(self._piece, most)

    @classmethod
    def _by_word(cls, settings: dict) -> bool:
        normalizers = (settings.get("normalizer") or {}).get("normalizers")
        splits = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = {"type": "Split", "pattern": {"Regex": cls._PATTERN}, "behavior": "Removed", "invert": True}
        plain = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"] for t in settings["added_tokens"])
        level = [{k: x.get(k) for k in ("type", "add_prefix_space", "use_regex")} for x in splits[1:]]
        return (
            normalizers == cls._NORMALIZERS and splits[0] == split and level == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
            and plain and settings.get("post_processor") is None and settings.get("truncation") is None
        )

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if "<|" in text or not text.isprintable():  # a special token's text, or odd characters: the library's whole path
            return self._whole(text)
        if text.isascii():
            found = self._SPLIT.findall(text.lower())
        else:
            found = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        return b"".join(map(self.pieces.__getitem__, found))

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._whole(text.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _writer(directory: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        filesystem, base = _filesystem(directory)
        name = f"part-{shard:05d}-{uuid.uuid4().hex}"
        out, offsets, at, tokens = None, [], 0, 0
        for batch in batches:
            for part in slices(batch):
                frames = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                    ids = enc.encode(text) + end
                    frames.append(frame(doc_id, ids, enc.width))
                    offsets.append(at)
                    at += len(frames[-1])
                    tokens += len(ids) // enc.width
                if out is None:
                    out = filesystem.open_output_stream(f"{base}/{name}.rec")
                out.write(b"".join(frames))
        if out is not None:
            out.close()
            with filesystem.open_output_stream(f"{base}/{name}.idx") as index:
                index.write(np.array([*offsets, at], dtype="<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(offsets)]), pa.array([tokens]), pa.array([at])],
                ["shard", "file", "records", "tokens", "bytes"],
            )

    return run


def write_records(docs: DataFrame, directory: str, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) as token records below ``directory`` in ascending doc_id order (null first; equal ids by the text's hash) and
    returns the manifest, itself a table in ``directory``/manifest. The range shuffle moves texts, before they are encoded.

    Null or empty text: only the end id. Repeated rows are records like others. An empty table: an empty manifest.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    filesystem, base = _filesystem(directory)
    filesystem.create_dir(base, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # what is sampled for the ranges; texts would go to the driver
    ranged = docs.select("doc_id", "text").repartitionByRange(n, *place).sortWithinPartitions(*place, F.col("text").asc_nulls_first())
    manifest = ranged.mapInArrow(_writer(directory, tokenizer, end_id), MANIFEST)
    manifest.write.parquet(f"{directory}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def read_frames(filesystem: pafs.FileSystem, path: str, picks: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard's records: all in order, or the picked ones through the index. A wrong checksum raises ValueError."""
    with filesystem.open_input_file(f"{path}.idx") as index:
        offsets = np.frombuffer(index.read(), dtype="<u8")
    with filesystem.open_input_file(f"{path}.rec") as f:
        for k in range(len(offsets) - 1) if picks is None else picks:
            if picks is not None or k == 0:
                f.seek(int(offsets[k]))
            frame = f.read(int(offsets[k + 1] - offsets[k]))
            size, check = _HEAD.unpack_from(frame)
            payload = frame[_HEAD.size : _HEAD.size + size]
            if masked_crc(frame[:8]) != check or masked_crc(payload) != struct.unpack_from("<I", frame, _HEAD.size + size)[0]:
                raise ValueError(f"record {k} of {path} is damaged")
            doc_id, none, width = _BODY.unpack_from(payload)
            yield None if none else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=_BODY.size)


def _reader(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(directory)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                for doc_id, ids in read_frames(filesystem, f"{base}/{file}"):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_records(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files: one task per shard, starts from the manifest's sums."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")
    starts = manifest.withColumn("start", F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens"))
    n = max(1, manifest.count())
    return starts.repartition(n, "shard").mapInArrow(_reader(directory), RECORD)


def token_records(docs: DataFrame, directory: str | None = None, **options) -> DataFrame:
    """Writes docs and reads the records back: one row per document."""
    directory = directory or shared_dir(docs.sparkSession, "token-records")
    write_records(docs, directory, **options)
    return read_records(docs.sparkSession, directory)
