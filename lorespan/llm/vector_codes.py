"""Vector codes: eight parts of a vector, each coded by the nearest entry of an integer codebook.

Components become whole numbers, so sums, distances and codebooks are exact and the same on any
number of machines. Codebooks are broadcast; a task computes the distances of an Arrow batch's parts to
all entries by |x|^2 - 2 x.c + |c|^2 in int64 matrix products and adds up what falls to each entry. A
round shuffles these sums alone, at most 128 rows a task, and merges them by part and entry; the
codebooks, whose size is that of 16 vectors, are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import cut, small_batches

#: Fixed point of components, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Sums of labels are broadcast up to so many labels, and joined by a shuffle beyond.
BROADCAST_LABELS = 100_000


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def usable(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, vector of the rows whose vector is neither null nor empty and has no component that is null or not finite."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(_finite(F.col("vector")))


def whole(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers: floor(SCALE * component), all floors down.

    A vector of another length is an error, and so are components for which a squared distance could
    leave the range of 64 bits.
    """
    sizes = np.asarray(column.value_lengths())
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} components, and one of {sizes[sizes != width][0]}")
    x = np.floor(np.asarray(column.flatten()).reshape(-1, width) * float(SCALE))
    if x.size and 4.0 * (width // PARTS) * np.abs(x).max() ** 2 >= 2.0**63:
        raise ValueError("a component is too large for exact distances in 64 bits")
    return x.astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows x (row, component) and codebooks (part, entry, component): the entry nearest to each part, the first of equal ones, and its squared distance; both (part, row)."""
    parts = x.reshape(len(x), len(books), -1).transpose(1, 0, 2)
    square = (parts * parts).sum(axis=2)[:, :, None] + (books * books).sum(axis=2)[:, None, :]
    distance = square - 2 * (parts @ books.transpose(0, 2, 1))
    entry = distance.argmin(axis=2)
    return entry, np.take_along_axis(distance, entry[:, :, None], axis=2)[:, :, 0]


def seeds(rows: DataFrame) -> np.ndarray | None:
    """The first codebooks (part, entry, component): the vectors of the 16 smallest ids of rows (usable), of fewer, all; None of no rows.

    Rows without an id count as one id after all others. Of rows of one id, the smallest vector
    counts. It is a top-16, made again where ids are repeated.
    """
    chosen: dict = {}
    left = rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * SCALE)).alias("vector"), "vector").toDF("vec_id", "floors", "vector")
    while len(chosen) < ENTRIES:
        found = left.orderBy(F.col("vec_id").asc_nulls_last(), "floors").limit(ENTRIES).collect()
        if not found:
            break
        for r in found:
            if len(chosen) < ENTRIES:
                chosen.setdefault(r["vec_id"], r["vector"])
        last = found[-1]["vec_id"]
        if last is None:
            break
        left = left.where((F.col("vec_id") > F.lit(last)) | F.col("vec_id").isNull())
    if not chosen:
        return None
    width = len(next(iter(chosen.values())))
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    x = whole(pa.array(list(chosen.values()), pa.list_(pa.float64())), width)
    return x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the mean, rounded down, of the parts of rows that it is nearest to; entries without any stay."""
    n_entries, size = books.shape[1:]
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = whole(batch.column(0), PARTS * size)
            entry, _ = nearest(x, books)
            chosen = (entry[:, None, :] == np.arange(n_entries)[None, :, None]).astype(np.int64)
            sums += chosen @ x.reshape(len(x), PARTS, size).transpose(1, 0, 2)
            counts += chosen.sum(axis=2)
        part, entry = np.nonzero(counts)
        made = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in made], ["part", "entry", "n", *(f"s{i}" for i in range(size))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(size))
    added = rows.select("vector").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)))
    new = books.copy()
    for r in added.collect():
        new[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    sent.destroy()
    return new


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks of rows (usable) after so many rounds; None if there are no rows."""
    books = seeds(rows)
    for _ in range(rounds if books is not None else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances of all parts added up) of rows (usable)."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            entry, distance = nearest(whole(batch.column("vector"), PARTS * books.shape[2]), books)
            raw = entry.T.astype(np.uint8).tobytes().hex()
            codes = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with vector: the entries that code names, put together and scaled back."""
    flat = [F.array(*(F.lit(x / SCALE) for x in entry)) for part in books.tolist() for entry in part]
    entries = F.array(*flat)
    each = books.shape[1]
    picked = [F.get(entries, (F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * each)) for p in range(PARTS)]
    return codes.withColumn("vector", F.flatten(F.array(*picked)))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error over all rows of the label, rows without one together), codebooks_sha256 of the rows that usable leaves.

    Rows with a vector that is null, empty, or has a component that is null or not finite are left out.
    All other vectors must be of one length, a multiple of 8 (else an error). Ties go to the lower
    entry. Repeated rows come as often; vec_id and label may be null and of any type that can be
    ordered; other columns are left aside; a table without usable rows gives an empty one.
    """
    small_batches(vectors.sparkSession, rows=4000)
    rows = usable(vectors, key=key, vector=vector, label=label)
    books = train(rows, rounds)
    if books is None:
        none = rows.limit(0)
        return none.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    coded = encode(rows, books)
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    right = sums.withColumnRenamed("label", "_label")
    right = F.broadcast(right) if sums.count() <= BROADCAST_LABELS else right
    joined = coded.join(right, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
