"""Token ids of texts in patched frame-of-reference blocks, and back.

The stream of ids is every document's ids and an end id, in the order of doc_id. It is kept as
segments of whole documents, rows of a Parquet table; a segment's bytes are, little-endian:

    "PFORIDS1", ids of a block (u32), blocks (u32), ids (u64)
    of each block: least id (u32), width (u8), outliers (u16), where its data start (u64)
    data of each block: ids less the block's least one, their lowest `width` bits, packed with the first bit
    lowest; then the outliers' positions (u16); then the bits above `width` of each (u32)

The width of a block is that of the value at the given percentile of it, so the few values that need
more bits are patched in from the list. The starts lead to any block without reading those before.
Documents are dealt by ranges of doc_id, each range's task writes its own segments, and where a range
starts in the stream follows from the counts of those before. So the files hold the whole stream in
order, while no task sees more than a range, and no row is longer than a segment or a document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import plain, small_batches

#: Ids of a block, the percentile that chooses its width, and ids from which on a segment is closed.
BLOCK, PERCENTILE, SEGMENT = 128, 90, 1 << 18
#: Bytes of texts that a Python worker gets at once.
BATCH = 8 << 20
#: Words whose ids a worker remembers, characters from which on a word is asked for by itself, and the mark between others: a number, so that it is never a part of a word.
MEMORY, WORD, MARK = 1 << 19, 64, "½"

_HEAD = struct.Struct("<8sIIQ")
_MAGIC = b"PFORIDS1"


# --- blocks


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _bits(values: np.ndarray, w: int) -> np.ndarray:
    """The lowest w bits of each value of rows (n, block) of uint32, one after another, the lowest first."""
    kind = "<u2" if w <= 16 else "<u4"
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8)
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(*values.shape, -1)[:, :, :w]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _values(packed: np.ndarray, block: int, w: int) -> np.ndarray:
    """The rows of which _bits made packed."""
    kind, whole = ("<u2", 16) if w <= 16 else ("<u4", 32)
    bits = np.zeros((len(packed), block, whole), np.uint8)
    bits[:, :, :w] = np.unpackbits(packed, axis=1, count=block * w, bitorder="little").reshape(len(packed), block, w)
    return np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little").view(kind)


def encode(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The bytes of a segment. ids are below 2**32; there may be none."""
    ids = np.asarray(ids, np.uint32)
    if not 0 < block <= 1 << 16:
        raise ValueError("a block has 1 to 65536 ids")
    n = -(-len(ids) // block)
    rows = np.zeros((n, block), np.uint32)
    rows.ravel()[: len(ids)] = ids
    if n:
        rows[-1, len(ids) - (n - 1) * block :] = rows[-1, 0]
    least = rows.min(axis=1) if n else np.zeros(0, np.uint32)
    rows -= least[:, None]
    at = min(block - 1, int(block * percentile / 100))
    width = np.ceil(np.log2(np.partition(rows, at, axis=1)[:, at] + 1.0)).astype(np.uint8)
    rest = (rows.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    outlier, place = np.nonzero(rest)
    many = np.bincount(outlier, minlength=n)
    packed = -(-block * width.astype(np.int64) // 8)
    sizes = packed + 6 * many
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        these = np.flatnonzero(width == w)
        for some in np.array_split(these, -(-len(these) // 512)):
            data[starts[some][:, None] + np.arange(packed[some[0]])] = _bits(rows[some], w)
    first = np.cumsum(many) - many
    nth = np.arange(len(outlier)) - first[outlier]
    where = starts[outlier] + packed[outlier]
    data[(where + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2")[:, None].view(np.uint8)
    data[(where + 2 * many[outlier] + 4 * nth)[:, None] + np.arange(4)] = rest[outlier, place].astype("<u4")[:, None].view(np.uint8)
    parts = _HEAD.pack(_MAGIC, block, n, len(ids)), least.astype("<u4").tobytes(), width.tobytes(), many.astype("<u2").tobytes(), starts.astype("<u8").tobytes()
    return b"".join((*parts, data.tobytes()))


def decode(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a segment, as uint32; only the blocks that hold them are unpacked."""
    magic, block, n, total = _HEAD.unpack_from(segment)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b, at, index = start // block, -(-stop // block), _HEAD.size, []
    for kind in ("<u4", "u1", "<u2", "<u8"):
        index.append(np.frombuffer(segment, kind, n, at)[a:b].astype(np.int64))
        at += n * np.dtype(kind).itemsize
    least, width, many, starts = index
    data = np.frombuffer(segment, np.uint8, offset=at)
    rows = np.zeros((b - a, block), np.uint32)
    packed = -(-block * width // 8)
    for w in np.unique(width[width > 0]).tolist():
        these = np.flatnonzero(width == w)
        for some in np.array_split(these, -(-len(these) // 512)):
            rows[some] = _values(data[starts[some][:, None] + np.arange(packed[some[0]])], block, w)
    outlier = np.repeat(np.arange(b - a), many)
    place = data[_places(starts + packed, 2 * many)].view("<u2")
    above = data[_places(starts + packed + 2 * many, 4 * many)].view("<u4")
    rows[outlier, place] += (above.astype(np.uint64) << width[outlier].astype(np.uint64)).astype(np.uint32)
    rows += least.astype(np.uint32)[:, None]
    return rows.ravel()[start - a * block : stop - a * block]


# --- texts to ids

# Classes of ASCII characters: 1 white space, 2 letters, 3 digits, 4 all others; 0 what isn't ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 4
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[48:58] = 3
# Words of small letters that no normal form joins or parts, and no lower case changes.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _apart(texts: pa.Array) -> pa.Array:
    """texts with a space wherever letters, digits and other ASCII characters meet, but for an apostrophe before a letter; A-Z in lower case, but before what isn't ASCII (it may combine with the letter)."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy() if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    kind = _CLASS[raw]
    following = np.zeros(len(raw), np.uint8)
    following[:-1] = kind[1:]
    raw[(raw >= 65) & (raw <= 90) & (following > 0)] += 32
    meet = np.flatnonzero((kind > 1) & (following > 1) & (kind != following) & ~((raw == 39) & (following == 2))) + 1
    moved = offsets - offsets[0]
    moved += np.searchsorted(meet, moved)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int32)), pa.py_buffer(np.insert(raw, meet, 32)))


class Encoder:
    """Ids of texts by a file of the tokenizers library, as encode(text, add_special_tokens=False) gives them.

    by_words says of a tokenizer that it makes lower case, parts words from what white space, digits and
    signs surround them, but for an apostrophe and what follows it, drops white space, and hands its
    model a word of small Latin letters as a whole, each letter spelt as it is by itself. Such a one is
    asked once for each different word of a batch: its model alone for words of these letters, the whole
    of it for many others in one text with a mark between them, and a bounded number of words is
    remembered. This gives the same ids.
    """

    def __init__(self, path: str, by_words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self._ids(MARK)
        self.by_words = by_words and len(self.mark) == 1
        pieces = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in map(chr, range(256)) if _LETTERS.fullmatch(c)} if by_words else {}
        self.spelt = {ord(c): "".join(p for p, _ in found) for c, found in pieces.items()}
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.sizes, self.flat = [], []
        self.n_ids = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        """Gives each of these new words a slot."""
        letters = list(filter(_LETTERS.fullmatch, words))
        ids = [[t.id for t in found] for found in map(self.tokenizer.model.tokenize, [w if w.isascii() else w.translate(self.spelt) for w in letters])]
        self.flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        self.sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.slots.update(zip(letters, range(len(self.slots), len(self.slots) + len(letters)), strict=True))
        rest = [w for w in words if not _LETTERS.fullmatch(w)]
        odd = [w for w in rest if MARK in w or len(w) > WORD]
        usual = [w for w in rest if not (MARK in w or len(w) > WORD)]
        for a in range(0, len(usual), 500):
            some = usual[a : a + 500]
            ids = np.array(self._ids(f" {MARK} ".join([*some, ""])), np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(some):
                odd += some
                continue
            self.flat.append(np.delete(ids, cuts))
            self.sizes.append(np.diff(cuts, prepend=-1) - 1)
            self.slots.update(zip(some, range(len(self.slots), len(self.slots) + len(some)), strict=True))
        for w in odd:
            self.flat.append(np.array(self._ids(w), np.uint32))
            self.sizes.append(np.array([len(self.flat[-1])]))
            self.slots[w] = len(self.slots)

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's with the end id after them, and how many each has."""
        found = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        special = np.zeros(len(texts), bool)
        for content in self.special if self.by_words else []:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            if special[at] or not self.by_words:
                ids, counts = np.array([*self._ids(texts[at].as_py()), end], np.uint32), None
                counts, to = np.array([len(ids)]), at + 1
            else:
                to = at + int(np.argmax(np.append(special[at:], True)))
                ids, counts = self._of_words(texts[at:to], end)
            found[0].append(ids)
            found[1].append(counts)
            at = to
        return np.concatenate(found[0]), np.concatenate(found[1])

    def _of_words(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > MEMORY or self.n_ids > 8 * MEMORY:
            self._forget()
        split = pc.ascii_split_whitespace(_apart(texts))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in distinct if w not in self.slots])
        self.flat, self.sizes = [np.concatenate([np.zeros(0, np.uint32), *self.flat])], [np.concatenate([np.zeros(0, np.int64), *self.sizes])]
        self.n_ids = len(self.flat[0])
        flat, sizes = np.append(self.flat[0], np.uint32(end)), np.append(self.sizes[0], 1)
        known = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int32, len(distinct))
        per_text = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(per_text)
        codes = np.insert(slots[words.indices.to_numpy(zero_copy_only=False)], ends, len(sizes) - 1)
        taken = known.take(pa.array(codes))
        counts = np.diff(taken.offsets.to_numpy()[np.append(0, ends + np.arange(1, len(ends) + 1))]).astype(np.int64)
        return taken.flatten().to_numpy(), counts


@cache
def _encoder(path: str, by_words: bool) -> Encoder:
    """The one of this worker, so that what it has learnt serves the next task, too."""
    return Encoder(path, by_words)


# --- tables


def write(docs: DataFrame, folder: str, path: str, end: int, *, by_words: bool = False, segment: int = SEGMENT, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
    """Writes the ids of docs (doc_id, text), by the tokenizer file path, with the id end after each document, as a Parquet table of segments in folder.

    Its columns: part (a range of doc_id), first (ids of the part before the segment), n_ids, doc_ids,
    lengths (ids of each document, the end id included), segment. Documents come by ascending doc_id,
    rows without one last; rows of one doc_id by their text's hash, then their text, so that reruns agree.
    A null text is an empty one and has the end id alone. doc_id may be of any type that can be
    ordered, texts of any length; a document is never cut, so one longer than a segment makes a longer
    one. Repeated rows come as often; other columns are left aside; an empty table gives no segment.
    """
    small_batches(docs.sparkSession, rows=2000, size=BATCH)
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = F.col("doc_id").asc_nulls_last()
    # equal rows may lie in any order; the last column parts them, should one doc_id have very many
    keyed = plain(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    dealt = keyed.repartitionByRange(order, "_hash", "_row").sortWithinPartitions(order, "_hash", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, part, first = _encoder(path, by_words), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            ids, lengths = np.concatenate([x for _, x, _ in held]), np.concatenate([n for *_, n in held])
            doc_ids = pa.concat_arrays([d for d, *_ in held])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            made = pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), one(doc_ids), one(pa.array(lengths)), pa.array([encode(ids, block, percentile)], pa.binary())
            return pa.RecordBatch.from_arrays(list(made), ["part", "first", "n_ids", "doc_ids", "lengths", "segment"])

        for batch in batches:
            ids, counts = to_ids(batch.column("text"), end)
            done = at = 0
            held_ids = sum(len(x) for _, x, _ in held)
            for i, total in enumerate(np.cumsum(counts).tolist(), 1):
                if held_ids + total - at >= segment or i == len(counts):
                    held.append((batch.column("doc_id").slice(done, i - done), ids[at:total], counts[done:i]))
                    held_ids, done, at = held_ids + total - at, i, total
                if held_ids >= segment:
                    yield closed()
                    first, held, held_ids = first + held_ids, [], 0
        if held:
            yield closed()

    schema = f"part int, first long, n_ids long, doc_ids array<{kind}>, lengths array<long>, segment binary"
    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The table that write made, with start: ids of the whole stream before each segment.

    It sums the counts of parts; their number is that of the tasks that wrote, so they pass through the driver.
    """
    rows = spark.read.parquet(folder)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, at = [], 0
    for part, n in counts:
        bases.append((part, at))
        at += n
    starts = spark.createDataFrame(bases, "part int, _base long")
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("_base") + F.col("first")).drop("_base")


def documents(stored: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, unless with_ids is false, ids (array<long>) of each document in stored (segments), made of the unpacked blocks."""
    small_batches(stored.sparkSession, rows=8, size=BATCH)
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column("segment")[i].as_py()).astype("<u4")
                lengths = np.array(batch.column("lengths")[i].values)
                ends = np.cumsum(lengths)
                begins, raw = ends - lengths, memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                made = [batch.column("doc_ids")[i].values, pa.array(begins + batch.column("start")[i].as_py()), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(made, names)

    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return stored.select("doc_ids", "lengths", "start", "segment").mapInArrow(run, schema)


def ids_between(stored: DataFrame, start: int, stop: int) -> DataFrame:
    """position, id of ids start to stop of the stream; of the segments that reach into this range, only the blocks that hold it are unpacked."""
    reach = stored.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).select("start", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, segment in zip(batch.column("start").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                a = max(0, start - at)
                ids = decode(segment, a, stop - at).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)) + at + a), pa.array(ids)], ["position", "id"])

    return reach.mapInArrow(run, "position long, id long")
