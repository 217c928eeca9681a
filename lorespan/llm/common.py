"""What several operators share: lineage cuts, text access in Arrow batches and word hashes."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap of wanted keys (16 MB).
BITS = 1 << 27
#: Texts are worked on in groups of about so many bytes.
CHUNK_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of this application for kept rows, in the one that the session names in spark.checkpoint.dir; it goes with the application.

    Only a local session may do without a name; it gets a folder of its own. On a cluster that would
    be a folder which other machines don't see, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    folder = context.getCheckpointDir()
    _filesystem(spark, folder).deleteOnExit(_path(spark, folder))
    return folder


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _filesystem(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, folder: str) -> None:
    _filesystem(spark, folder).delete(_path(spark, folder), True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder from now on."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Rows that a job keeps in the shared folder while it works: checkpoints (cut) and Parquet, which takes less room (keep).

    drop() deletes some of them, leaving the block all that are left. What a result still reads when
    its caller gets it is kept outside of a block, by common.cut, as long as the application lives.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, shared_checkpoints(spark)
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in list(self.held.values())))

    def cut(self, df: DataFrame) -> DataFrame:
        rows = cut(df)
        self.held[id(rows)] = rows, rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        return rows

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(rows)] = rows, path
        return rows

    def drop(self, *rows: DataFrame) -> None:
        for df in rows:
            remove(self.spark, self.held.pop(id(df))[1])


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints of steps that nothing refers to any more; it does so when objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Bounds what a Python worker gets at once, in rows and bytes (a longer text comes alone). The session keeps the setting, since plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame, *cols: str) -> DataFrame:
    """Only these columns, so that no other one can clash with ours; a null text is an empty one."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("text", "html") else F.col(c) for c in cols))


def perhaps(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds _perhaps to rows, without a shuffle: true where the key is one of keys, and for a few others.

    The keys' hashes are marked in a bitmap of BITS bits, which is broadcast and whose size does not
    grow with the data. A join has the last word on those marked.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    marks = keys.select(at(key).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_marks"))
    place = F.bitmap_bit_position(at(key))
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(marks), F.bitmap_bucket_number(at(key)) == F.col("_bucket"), "left")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias("_perhaps"))


def utf8(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about CHUNK_BYTES."""
    column = utf8(column)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
                self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)])
        return self.up, self.down


_POWERS = Powers()
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_HASH = _BYTES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word between white space, and the number of words before each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _POWERS.upto(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER_HASH[data] * up[:n], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _M1)
    return hashes, np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct sorted hashes of the runs of width words; of fewer words, of the whole run; of none, nothing."""
    n = len(hashes)
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        w = min(n, width)
        total = np.full(n - w + 1, np.uint64(w), np.uint64)
        for i in range(w):
            total = total * np.uint64(_BASE) + hashes[i : n - w + 1 + i]
        return np.unique(mix(total))
