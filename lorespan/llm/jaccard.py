"""N-gram Jaccard self-join by PartEnum signatures.

Documents are compared as sets of hashed word shingles. Sets fall into bands of like size; a
band fixes how many features (k) two similar sets may differ in. The feature domain is dealt by
hash into n1 partitions of N2 cells, so many that in at least one partition two similar sets
differ in at most K2 cells; there they agree on one of the subsets of N2 - K2 cells. The hash of
a subset's features is a signature, and similar sets share at least one.

n1 has a few partitions to spare, so two similar sets agree in one more than those. A signature of
over HOT classes (mostly made of a passage that many documents hold, or of nothing) is therefore
left out by each set that has no more such signatures than partitions to spare: a partition where
it agrees with a similar set remains, and the other set keeps or leaves out the same signatures or
keeps all. A set with more hot signatures keeps all of them.

Plan: (1) one pass gives each document its set's size and key, and equal sets become one class;
(2) a second pass packs signatures into blocks, dealt by signature, with repeats inside a task
merged before the shuffle; a signature of two or more classes survives; (3) each class is tested
against the best connected class of each of its signatures, on exact sets; (4) components; (5)
classes that share a signature but no component are compared by parity sketches, those that can
be similar on exact sets, and components follow again. So a group of n near copies takes about n
tests, and no link between components is lost. A sketch has at least two bits a feature; each
feature flips one of them, so sketches differ in no more bits than the sets in features. Classes that
come to (5) by a signature which many share are compared under their rarest features instead.

Set keys and features are 64-bit hashes; nothing else is approximate.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import Scratch, chunks, cut, mix, plain, shingles, small_batches, tidy, words

#: Cells of a partition, and how many of them may differ.
N2, K2 = 3, 1
#: How many classes make a signature hot.
HOT = 50
#: Frequent features that are told apart by their counts (16 MB).
FREQUENT = 1 << 20
#: Features that a task counts at once.
COUNTED = 1 << 22
#: Nodes whose sets are wanted that are broadcast, 16 bytes each; beyond, texts are shuffled to them.
BROADCAST_NODES = 4_000_000
#: Signatures that a task gathers before it packs them.
PACK = 1 << 18
#: Bits of a short sketch; that of a larger set has twice as many, and so on, and folds to it.
SKETCH = 1024
_WORDS = [f"s{i}" for i in range(SKETCH // 64)]
_SUBSETS = np.array([[i in c for i in range(N2)] for c in combinations(range(N2), N2 - K2)])
#: A pair is shuffled as its first 14 bytes: signatures have 48 bits.
_PAIR = np.dtype([("key", "<u8"), ("sig", "<u8")])
_PACKED, _SIG_BITS = 14, np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least percent / 100 over shingles of width words."""

    width: int = 5
    percent: int = 80

    def close(self, small, large):
        """Whether sets of these sizes can be similar (columns or numbers)."""
        return small * 100 >= large * self.percent


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> np.ndarray:
    """Lower bounds of the bands of size, up to most. Similar sets are in one band or in neighbours.

    The smallest sets of a band have the fewest features in a signature, and so the most empty ones;
    where k is large against sizes (below 85 percent) bands are as narrow as they can be.
    """
    wide = percent if percent >= 85 else 100
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 10_000 // (percent * wide) + 1)
    return np.array(out)


def needed(percent: int, bounds: np.ndarray, j: int) -> int:
    """Partitions of band j of which one at least differs in K2 features at most; 0 where similar sets are equal sets."""
    k = 2 * int(bounds[j + 1] - 1) * (100 - percent) // (100 + percent)
    return k and k // (K2 + 1) + 1


def own_bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, partitions needed) for a set of n features: its own band and, where a similar set can be there, the next one."""
    bounds = bands(percent, 1 << max(20, n.bit_length() + 2))
    j = int(np.searchsorted(bounds, n, "right")) - 1
    found = [(x, needed(percent, bounds, x)) for x in ((j, j + 1) if n * 100 >= int(bounds[j + 1]) * percent else (j,))]
    return [x for x in found if x[1]]


def spare(need: int, percent: int) -> int:
    """Partitions to spare: about as many as have an empty signature in the smallest sets of a band, at least."""
    return int(np.ceil((0.05 if percent >= 85 else 0.12) * need))


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set."""
    out = [features[:0]]
    for band, need in own_bands(len(features), percent) if len(features) else ():
        n1 = need + spare(need, percent)
        with np.errstate(over="ignore"):
            cell = (mix(features ^ np.uint64(band + 1)) % np.uint64(n1 * N2)).astype(np.int64)
            value = mix(features + np.uint64(0x51ED270B))
            low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(float), n1 * N2).astype(np.uint64)
            high = np.bincount(cell, (value >> np.uint64(32)).astype(float), n1 * N2).astype(np.uint64)
            total = (low + (high << np.uint64(32))).reshape(n1, N2)
            sums = np.stack([total[:, s].sum(axis=1, dtype=np.uint64) for s in _SUBSETS], axis=1)
            name = np.arange(n1 * len(_SUBSETS), dtype=np.uint64).reshape(n1, -1) + np.uint64(band << 40)
            out.append(mix(sums ^ mix(name + np.uint64(1))).ravel())
    return np.concatenate(out)


def set_key(features: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of hashed features, as 64-bit words."""
    bits = SKETCH
    while bits < 2 * len(features):
        bits *= 2
    at = (mix(features + np.uint64(0x2545F491)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _middle(n: int) -> int:
    """Words of the sketch that a large set carries in the residual comparison: at least two bits for three features."""
    words = len(_WORDS)
    while words * 64 * 3 < 2 * n:
        words *= 2
    return words


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, data, offsets in chunks(column):
        hashes, at = words(data, offsets)
        for i in range(b - a):
            yield a + i, shingles(hashes[at[i] : at[i + 1]], width)


def profile(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set), spare (hot signatures that it may leave out) and its sketch."""

    def run(batches):
        for batch in batches:
            sets = [x for _, x in _sets(batch.column("text"), sim.width)]
            long = [sketch(x) for x in sets]
            middle = [None if len(x) <= SKETCH * 3 // 2 else y.reshape(-1, _middle(len(x))) for x, y in zip(sets, long, strict=True)]
            middle = [None if y is None else np.bitwise_xor.reduce(y) for y in middle]
            bits = np.array([np.bitwise_xor.reduce(x.reshape(-1, len(_WORDS))) for x in long], np.int64).reshape(len(sets), len(_WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()), pa.array([min((spare(need, sim.percent) for _, need in own_bands(max(1, len(x)), sim.percent)), default=0) for x in sets], pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(_WORDS))), pa.array(long, pa.list_(pa.int64())), pa.array(middle, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "spare", *_WORDS, "sketch", "middle"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key long, spare int, " + ", ".join(f"{x} long" for x in _WORDS) + ", sketch array<long>, middle array<long>")


def _pack(found: list[np.ndarray], blocks: int) -> pa.RecordBatch:
    """Blobs of (signature, key) by block; block is -1 - x for pairs known to share a signature."""
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs["key"], pairs["sig"]))]
    again = pairs["sig"][1:] == pairs["sig"][:-1]
    shared = np.r_[again, False] | np.r_[False, again]
    ids, blobs = [], []
    for rows, by, known in ((pairs[np.r_[True, ~again]], "sig", False), (pairs[shared], "key", True)):
        block = (mix(rows[by]) % np.uint64(blocks)).astype(np.int64)
        rows = rows[np.argsort(block, kind="stable")]
        ends = np.cumsum(np.bincount(block, minlength=blocks))
        for x, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
            if b > a:
                ids.append(-1 - x if known else x)
                blobs.append(np.ascontiguousarray(rows[a:b]).view(np.uint8).reshape(b - a, _PAIR.itemsize)[:, :_PACKED].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["block", "pairs"])


def shared_signatures(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(sig, key) for signatures of two or more sets; a row may come twice."""
    spark = docs.sparkSession
    blocks = 4 * max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def emit(batches):
        found, n, seen = [], 0, set()
        for batch in batches:
            for _, features in _sets(batch.column("text"), sim.width):
                if not len(features) or (key := set_key(features)) in seen:
                    continue
                seen.add(key)
                sigs = np.unique(signatures(features, sim.percent) & _SIG_BITS)
                pairs = np.empty(len(sigs), _PAIR)
                pairs["sig"], pairs["key"] = sigs, np.uint64(key & 0xFFFFFFFFFFFFFFFF)
                found.append(pairs)
                n += len(pairs)
                if n >= PACK:
                    yield _pack(found, blocks)
                    found, n, seen = [], 0, set()
        if n:
            yield _pack(found, blocks)

    def rows(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[x]).view(np.int64)) for x in ("sig", "key")], ["sig", "key"])

    def unpacked(packed: np.ndarray) -> np.ndarray:
        pairs = np.zeros((len(packed), _PAIR.itemsize), np.uint8)
        pairs[:, :_PACKED] = packed
        return pairs.view(_PAIR).ravel()

    def meet(batches):
        waiting = defaultdict(list)
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("pairs"), strict=True):
                packed = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, _PACKED)
                if block < 0:
                    yield rows(unpacked(packed))
                else:
                    waiting[block].append(packed.copy())
        while waiting:  # block by block, to keep little unpacked at once
            pairs = unpacked(np.concatenate(waiting.popitem()[1]))
            pairs = pairs[np.lexsort((pairs["key"], pairs["sig"]))]
            pairs = pairs[np.r_[True, (pairs["sig"][1:] != pairs["sig"][:-1]) | (pairs["key"][1:] != pairs["key"][:-1])]]
            again = pairs["sig"][1:] == pairs["sig"][:-1]
            pairs = pairs[np.r_[again, False] | np.r_[False, again]]
            if len(pairs):
                yield rows(pairs)

    return docs.mapInArrow(emit, "block int, pairs binary").repartition("block").mapInArrow(meet, "sig long, key long")


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """node, items: the sets of class nodes, made of the texts of these nodes only."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            out = [(ids[i], x.view(np.int64)) for i, x in _sets(batch.column("text"), sim.width) if len(x) and set_key(x) == keys[i]]
            for i in range(0, len(out), 200):
                part = out[i : i + 200]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.list_(pa.int64()))], ["node", "items"])

    wanted = scratch.cut(nodes.select("node").distinct().join(classes.select("node", "key"), "node").select(F.col("node").alias("doc_id"), "key"))
    few = wanted.count() <= BROADCAST_NODES
    return docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "key", "text").mapInArrow(run, "node long, items array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of class nodes, those whose sets are similar."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, classes, sim, scratch)
    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("items_a") + F.size("items_b") - both) * sim.percent).select("a", "b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the least node that each node of the edges (a, b) reaches. Labels spread along edges and then jump to their label's label, so that the rounds grow with the logarithm of a path."""
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # cut here, so that both sides of the next join are plain exchanges: a label that many nodes have can be split
        spread = scratch.cut(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.cut(spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        scratch.drop(spread, labels)
        if new.where("label != old").isEmpty():
            scratch.drop(both)
            return new
        labels = new


def _can_be(sim: Similarity, n: Column, m: Column, differ: Column) -> Column:
    """False only if sets of n and m features whose sketches differ in so many bits aren't similar."""
    return sim.close(F.least(n, m), F.greatest(n, m)) & (differ * (100 + sim.percent) <= (n + m) * (100 - sim.percent))


def _likely(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of nodes without those whose sketches tell that they aren't similar."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    a, b = (F.when(F.size(f"sketch_{x}") > F.size(f"sketch_{y}"), half(F.col(f"sketch_{x}"))).otherwise(F.col(f"sketch_{x}")) for x, y in ("ab", "ba"))
    pairs = pairs.where(sim.close(F.least("n_a", "n_b"), F.greatest("n_a", "n_b")))
    differ = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return pairs.where(_can_be(sim, F.col("n_a"), F.col("n_b"), differ)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; other columns are left aside).

    component_id is the least doc_id that links reach, its own included. A null text is an empty
    one; an empty set links with nothing. Repeated rows come back as often. Rows of one doc_id with
    different texts count as one document with respect to links. A row without doc_id links with
    nothing and has no component_id. doc_id must be an integer, or cast to one that fits 64 bits, else
    it is an error. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        return cut(_linked(plain(docs, "doc_id", "text"), Similarity(width, percent), scratch))


def _linked(docs: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    profiles = scratch.keep(profile(docs, sim))
    known = docs.where(F.col("doc_id").isNotNull())
    classes = scratch.keep(profiles.where("doc_id is not null and key is not null").groupBy("key", "n_shingles", "spare").agg(F.min("doc_id").alias("node"), *(F.first(x).alias(x) for x in (*_WORDS, "sketch", "middle"))))
    # Equal sets, and different sets of one doc_id, are linked to begin with.
    same = profiles.where("doc_id is not null").join(classes.select("key", "n_shingles", "node"), ["key", "n_shingles"]).where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # A row may come twice here; that makes a signature hot a little sooner, for all of its sets.
    found = scratch.keep(shared_signatures(known, sim).join(classes.select("key", "node", F.col("n_shingles").alias("n"), "spare"), "key").select("sig", "node", "n", "spare"))
    tidy(spark)
    hot = found.groupBy("sig").count().where(F.col("count") > HOT).select("sig", F.lit(True).alias("hot"))
    marked = found.join(hot, "sig", "left").select("sig", "node", "n", "spare", F.coalesce("hot", F.lit(False)).alias("hot"))
    many = marked.where("hot").groupBy("node").agg(F.count("*").alias("n_hot"))
    members = scratch.keep(marked.join(many, "node", "left").where("not hot or n_hot > spare").select("sig", "node", "n"))
    scratch.drop(found)
    del hot, marked, many
    tidy(spark)
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "node").groupBy("sig").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    # hubs are tested against all others of their signatures, so they are needed no more
    others = scratch.keep(members.join(hubs, "sig").where("node != hub"))
    scratch.drop(members)
    del degree, hubs
    tidy(spark)
    pairs = others.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = scratch.cut(_likely(pairs, classes, sim))
    edges = scratch.cut(_verified(first, known, classes, sim, scratch).union(same.distinct()))
    labels = components(edges, scratch)
    tidy(spark)
    # What shares a signature and is in different components yet.
    at = others.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = at.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("sig")
    apart = scratch.keep(at.join(mixed, "sig").select("sig", "node", "n", "label"))
    scratch.drop(others)
    del mixed
    tidy(spark)
    met = _met(_narrowed(apart, known, classes, sim, scratch), classes, sim)
    rest = scratch.cut(_likely(met.join(first, ["a", "b"], "left_anti"), classes, sim))
    scratch.drop(apart, first)
    tidy(spark)
    more = scratch.cut(_verified(rest, known, classes, sim, scratch))
    if not more.isEmpty():
        labels = components(edges.union(more), scratch)
    out = profiles.select("doc_id", "n_shingles").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _narrowed(apart: DataFrame, docs: DataFrame, classes: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """Rows (sig, node, n, label) by which classes of different components are to be compared: under their rarest features instead of their signatures.

    Two similar sets of n and m features have one of the n - ceil(s n) + 1 first of the one (s: the
    least similarity) in common with as many of the other, if first is by the same order for both. In
    this order frequent features come last, by their counts, of which the FREQUENT highest are broadcast;
    others come by hash. (Any order gives the same pairs in the end. So a feature that a task sees once
    among COUNTED isn't counted there, and is not shuffled.) A passage that makes a signature hot, as a licence does, is last; so a million
    texts with little else in common are not compared with each other.
    """
    crowd = scratch.cut(apart.select("node", "n", "label").distinct())
    found = scratch.keep(_sets_of(crowd, docs, classes, sim, scratch))

    def seen(batches):
        parts, n = [], 0

        def again():
            feature, many = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(feature[many > 1]), pa.array(many[many > 1])], ["feature", "many"])

        for batch in batches:
            parts.append(batch.column("items").flatten().to_numpy(zero_copy_only=False).copy())
            n += len(parts[-1])
            if n >= COUNTED:
                yield again()
                parts, n = [], 0
        if n:
            yield again()

    counts = found.select("items").mapInArrow(seen, "feature long, many long").groupBy("feature").agg(F.sum("many").alias("many")).where(F.col("many") > HOT)
    top = counts.orderBy(F.col("many").desc(), "feature").limit(FREQUENT).select("feature").toArrow()
    frequent = top["feature"].to_numpy()[::-1]  # the rarest of them first
    by_value = np.argsort(frequent, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((frequent[by_value], by_value))

    def run(batches):
        known, rank = sent.value
        for batch in batches:
            nodes, sigs = [], []
            for node, items in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
                x = items.values.to_numpy(zero_copy_only=False)
                place = np.full(len(x), -1, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    place = np.where(known[at] == x, rank[at], -1)
                first = np.lexsort((x, place))[: len(x) - -(-len(x) * sim.percent // 100) + 1]
                sigs.append(x[first])
                nodes.append(np.full(len(first), node, np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])

    rows = found.mapInArrow(run, "sig long, node long")
    rows = scratch.keep(rows.join(crowd, "node").select("sig", "node", "n", "label"))
    scratch.drop(found, crowd)
    mixed = rows.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("sig")
    return scratch.cut(rows.join(mixed, "sig"))


def _met(apart: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of nodes of rows (sig, node, n, label) that share a signature, aren't in one component and can be similar by their short sketches."""
    at = apart.join(classes.select("node", *_WORDS, "middle"), "node")
    other = at.select("sig", *(F.col(x).alias(f"{x}_") for x in ("node", "n", "label", *_WORDS, "middle")))
    differ = sum((F.bit_count(at[x].bitwiseXOR(other[f"{x}_"])) for x in _WORDS), F.lit(0))
    met = (at["sig"] == other["sig"]) & (F.col("node") < F.col("node_")) & (F.col("label") != F.col("label_"))
    # large sets carry more bits, which are looked at where the short sketch tells nothing
    more_bits = F.aggregate(F.zip_with("middle", "middle_", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    unlike = F.when(F.size("middle") == F.size("middle_"), more_bits > (F.col("n") + F.col("n_")) * (100 - sim.percent) / (100 + sim.percent))
    met = met & _can_be(sim, F.col("n"), F.col("n_"), differ) & ~F.coalesce(unlike, F.lit(False))
    return at.join(other, met).select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct()


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, in all their columns, with the document of least doc_id of each component; of rows with one doc_id one stays. Rows without doc_id stay."""
    found = near_duplicates(docs, width, percent)
    gone = cut(found.where("doc_id != component_id").select("doc_id").distinct())
    few = gone.count() <= BROADCAST_NODES
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
