"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark setting: shuffle files go when the query that wrote them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: list[list[str]] = []
#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 20
_U = np.uint64
#: Words of more bytes are hashed by BLAKE2b.
_LONG = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share. Unset: an error, since a folder of one machine won't do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """Jobs started inside drop their shuffle files when they end; later jobs read the tables that they wrote."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Writes df as a Parquet table (with a folder for each value of some columns) in the shared folder and reads it again: lineage ends
    there, and a lost executor takes nothing along.

    Inside ``scratch`` the table goes when the block ends; ``release`` removes it sooner.
    """
    path = shared_dir(df.sparkSession, name)
    for kept in _kept:
        kept.append(path)
    with _shuffles_go(df.sparkSession):
        df.write.partitionBy(*folders).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_to)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What operators materialize inside the block is removed at its end: write or collect their results before."""
    paths: list[str] = []
    _kept.append(paths)
    try:
        yield
    finally:
        _kept.remove(paths)
        for path in paths:
            _remove(spark, path)


def with_row(docs: DataFrame, *extra: Column) -> DataFrame:
    """extra columns beside all columns of docs as one struct ``row``, so that no name of an operator meets a name of the table."""
    return docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row"), *extra)


def row_columns(docs: DataFrame, **replaced: Column) -> list[Column]:
    """docs' columns out of ``row``; replaced: other values for some of them."""
    return [replaced[c] if c in replaced else F.col("row").getField(c).alias(c) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_key(text: str = "text"):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.col(text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- inside tasks


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", most: int = _BLOCK):
    """Cuts a batch so that each part holds about ``most`` bytes of text, or one long text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def _hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: their eight-byte pieces, one after the other through the finalizer; long words by BLAKE2b."""
    padded = np.r_[b, np.zeros(8, np.uint8)]
    pieces = np.ndarray((len(b) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = stop - start
    h = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    live = np.arange(len(start))
    for at in range(0, _LONG, 8):
        if at:
            live = live[size[live] > at]
        if not len(live):
            break
        rest = np.minimum(size[live] - at, 8)
        h[live] = mix((h[live] * _U(0xD6E8FEB86659FD93)) ^ (pieces[start[live] + at] & _FIRST[rest]))
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(b[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (bytes) of every word of UTF-8 data, block by block."""
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _BLOCK)
        if end < n:
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            while cut < at and end < n:  # one word longer than the block
                end = min(n, end + _BLOCK)
                cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = n if cut < at else cut + 1
        b = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        word = np.zeros(len(b) + 2, dtype=bool)
        np.logical_not(_SPACE[b], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edges[0::2], edges[1::2]
        if len(start):
            found.append((_hashes(b, start, stop), start + at, stop + at))
        at = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def words_of_docs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, and each word's text (its index)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    h, start, _ = word_hashes(b" ".join(texts))
    return h, np.searchsorted(ends, start, side="right")


def shingles_of_docs(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of several texts, and each one's text. A text of 1 to n - 1 words has one shingle: all its words."""
    h, doc = words_of_docs(texts)
    if not len(h):
        return h, doc
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1) | 1)
    whole = doc[: len(out)] == doc[n - 1 :][: len(out)]
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < n))
    extra = []
    firsts = np.cumsum(counts) - counts
    for d in short:
        own = h[firsts[d] : firsts[d] + counts[d]]
        x = np.uint64(counts[d])
        for v in own:
            x = mix(np.array([x ^ v], dtype=np.uint64))[0] + np.uint64(1)
        extra.append(x)
    return np.concatenate([mix(out[whole]), np.array(extra, dtype=np.uint64)]), np.concatenate([doc[: len(out)][whole], short])
