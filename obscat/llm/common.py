"""What the operators of this subpackage share: tables, scratch storage, hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII upper-case letters, the only ones that are lower-cased.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes between words: space and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POLY = 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: dict[int, str] = {}


class _Open(threading.local):
    """Tables that this thread has stored since each open ``passing`` began, the innermost last."""

    def __init__(self):
        self.stack: list[list[str]] = []


_open = _Open()
#: Makes Spark remove a query's shuffle files when the query ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scratch files of a local path have no side file of checksums: Hadoop starts a chmod for every file and folder that it
#: makes there, and each is a copy of the executor until it runs.  The pages' own checksums are verified instead.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
_VERIFY = "parquet.page.verify-checksum.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder for written intermediate tables, below ``spark.checkpoint.dir``.

    Only where that setting is unset and the master is local, as in tests, a
    temporary folder takes its place.  The folder is removed when the session's
    process ends.
    """
    key = id(spark.sparkContext)
    if key not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="obscat-")
        _scratch[key] = f"{base.rstrip('/')}/obscat-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _scratch[key]


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Remove what ``stored`` has written in this session."""
    path = _scratch.pop(id(spark.sparkContext), None)
    if path and spark.sparkContext._jsc is not None:
        try:
            _delete(spark, path)
        except Exception:  # the gateway may be gone already when the process ends
            pass


def _written(df: DataFrame, *parts: str) -> str:
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.options(**_PLAIN)
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    if _open.stack:
        _open.stack[-1].append(path)
    return path


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).option(_VERIFY, "true").parquet(path)
    out._stored_at = path
    return out


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back.

    This cuts the lineage: later jobs start from files that every executor can
    read, whichever executors have been lost since.  The shuffle files of the
    query go with its end.
    """
    return _table(df.sparkSession, _written(df), df.schema)


def stored_by(df: DataFrame, kind: str, values: Sequence[str]) -> list[DataFrame]:
    """Like stored, in one pass: a table for each value of the column kind, without that column."""
    path, schema = _written(df, kind), T.StructType([f for f in df.schema if f.name != kind])
    out = []
    for value in values:
        own = f"{path}/{kind}={value}"
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(own)
        files = jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        if not files.exists(jpath):
            files.mkdirs(jpath)
        out.append(_table(df.sparkSession, own, schema))
    return out


def let_go(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored within the block go at its end, but for those given to what it yields."""
    _open.stack.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._stored_at)
        return df

    try:
        yield keep
    finally:
        for path in _open.stack.pop():
            if any(k.startswith(path) for k in kept):
                if _open.stack:
                    _open.stack[-1].append(path)
            else:
                _delete(spark, path)


def shrink(spark: SparkSession) -> None:
    """Collect the executors' Java heaps, one small task for each, so that they return what they no longer hold.

    A heap keeps the size that its busiest moment made it grow to until a whole
    collection, which a long run of short-lived objects may never bring about; the
    Python workers beside it and later stages then have to do with the rest.
    """
    n = max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is one of them
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def shards(spark: SparkSession) -> int:
    """Number of key ranges for keyed exchanges, as the cluster is tuned."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(col):
    return F.translate(col, UPPER, UPPER.lower())


def crc_mod5(col):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % 5


def give_back() -> None:
    """Return freed memory to the system; a worker is kept for later tasks, which may be of another kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


#: What a worker keeps from task to task, by the kind of task that uses it.
_held: dict[str, dict] = {}


def held(kind: str) -> dict:
    """What this worker keeps for tasks of a kind, until a task of another kind begins."""
    return _held.setdefault(kind, {})


def drop_others(kind: str = "") -> None:
    """Let go what this worker keeps for tasks of other kinds."""
    for k in [k for k in _held if k != kind]:
        del _held[k]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str = ""):
    """run for mapInArrow, without what tasks of other kinds kept, and with freed memory returned at the end of each task."""

    def whole(batches):
        drop_others(kind)
        yield from run(batches)
        give_back()

    return whole


def frugal_group(merge: Callable[[pa.Table], pa.Table]):
    """merge for applyInArrow, without what tasks of other kinds kept, and with freed memory returned after each group."""

    def whole(found):
        drop_others()
        out = merge(found)
        del found
        give_back()
        return out

    return whole


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_ZSTD = pa.Codec("zstd", 1)


def pack(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(data: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), dtype)


def pack_columns(*columns: np.ndarray) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in map(pack, columns))


def unpack_columns(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def pieces(b: pa.RecordBatch, *columns: int, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes in the columns each; a longer row is a slice of its own."""
    size = sum(pa.compute.fill_null(pa.compute.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns)
    total, first = np.cumsum(size, dtype=np.int64), 0
    while first < b.num_rows:
        done = int(total[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield b.slice(first, last - first)
        first = last


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_POLY**i and its inverse modulo 2**64, for i < n."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _POLY), ("inv", pow(_POLY, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            filled, step = 1, base
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(step)
                step = step * step % (1 << 64)
                filled *= 2
            _powers[name] = out
    return _powers["p"], _powers["inv"]


def words(data: np.ndarray, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every maximal run of non-space bytes.

    Long data is taken in blocks that end at a space, so what is held beside the
    result does not grow with it; only a longer word makes a longer block.
    """
    found, at = [], 0
    while at < len(data):
        stop = at + block
        while stop < len(data) and not len(gap := np.flatnonzero(_IS_SPACE[data[stop : stop + block]])):
            stop += block
        stop = len(data) if stop >= len(data) else stop + int(gap[0])
        starts, ends, hashes = _words(data[at:stop])
        found.append((starts + at, ends + at, hashes))
        at = stop
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found))) if found else (none, none, np.zeros(0, np.uint64))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = np.empty(n + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return starts, ends, mix64(raw ^ ((ends - starts).astype(np.uint64) * MULT))


def slabs(rows: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of consecutive rows, joined by a space, of about limit bytes each.

    Gives first row, row after the last, the bytes, and the end of each row's
    bytes (its separator included).  A longer row makes a slab of its own.
    """
    first, size = 0, 0
    for i, row in enumerate(rows):
        if size and size + len(row) > limit:
            yield first, i, *_joined(rows[first:i])
            first, size = i, 0
        size += len(row) + 1
    if first < len(rows):
        yield first, len(rows), *_joined(rows[first:])


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(rows) + b" ", np.uint8)
    return data, np.cumsum([len(r) + 1 for r in rows])


# A filter over 64-bit keys whose size has a fixed bound ----------------------

BLOOM_MAX_BITS = 1 << 27


class KeyFilter:
    """Bloom filter of at most BLOOM_MAX_BITS bits (16 MB): no false negatives.

    Beyond some ten million keys it only passes more rows; what passes is always
    checked exactly afterwards.
    """

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def positions(keys: np.ndarray, bits: int) -> np.ndarray:
        keys = keys.astype(np.uint64)
        return np.concatenate([mix64(keys ^ np.uint64((k + 1) * int(MULT) % (1 << 64))) & np.uint64(bits - 1) for k in range(4)])

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        at = self.positions(keys, self.bits)
        hit = (self.data[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return hit.reshape(4, -1).all(axis=0)


def key_filter(df: DataFrame, column: str) -> KeyFilter:
    """A KeyFilter of a long column, built on the executors word by word."""
    n = df.count()
    bits = min(BLOOM_MAX_BITS, 1 << max(16, (16 * n).bit_length()))
    schema = pa.schema([("word", pa.int32()), ("mask", pa.int64())])

    def build(batches):
        for b in batches:
            keys = np.array(b.column(0).drop_null().to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            at = np.unique(KeyFilter.positions(keys, bits))
            word = (at >> np.uint64(6)).astype(np.int32)
            mask = np.uint64(1) << (at & np.uint64(63))
            if len(word):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                yield batch(schema, word[first], np.bitwise_or.reduceat(mask, first).view(np.int64))

    found = df.select(column).mapInArrow(frugal(build), "word int, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    data = np.zeros(bits // 64, np.uint64)
    data[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return KeyFilter(bits, data)
