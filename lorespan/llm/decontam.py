"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

A text is normalised byte by byte: A-Z lower-cased, every other ASCII character that is no letter
or digit taken as a gap, the rest kept. All windows of WINDOW consecutive words of all items (an item
of fewer words is one window) go into one automaton, in which each word of the items is a code of a
few characters, all of one length, and any other word a code of its own; so a match covers whole
words, and its end tells the word it ends at. Each text is scanned once, and words give offsets in the
original text.

The automaton is made of a broadcast list of items, whose size is checked: a node takes about 40 bytes,
and MOST_WORDS words of items at most 50 nodes a word. Items beyond that take further passes over the
texts, each with an automaton of its own; hit words of all passes are put together before anything is
counted or joined to passages, so the number of passes changes no result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import cut, plain, small_batches

#: Words of a window.
WINDOW = 13
#: Words of items in one automaton (about 300 MB).
MOST_WORDS = 150_000
_NORMAL = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))
_LETTERS = [chr(48 + i) for i in range(64)]
_HIT = "array<struct<word:long,start:long,end:long>>"


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def _places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) code point of each word: the normalised bytes stand where the original's do."""
    inside = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    step = np.diff(np.r_[False, inside, False].astype(np.int8))
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return points[np.flatnonzero(step == 1)], points[np.flatnonzero(step == -1)]


class Matcher:
    """An automaton of the windows of items: (id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        owners = defaultdict(set)
        for name, text in items:
            words = normal_words((text or "").encode())
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(name)
        known = sorted({w for words in owners for w in words})
        self.width = 1
        while len(_LETTERS) ** self.width < len(known):
            self.width += 1
        self.codes = {w: "".join(_LETTERS[i // len(_LETTERS) ** p % len(_LETTERS)] for p in range(self.width)) for i, w in enumerate(known)}
        self.other = "\0" * self.width
        self.found = [(len(w), sorted(names)) for w, names in owners.items()]
        self.automaton = ahocorasick.Automaton()
        for i, words in enumerate(owners):
            self.automaton.add_word("".join([self.codes[w] for w in words]), i)
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """Of a text: the number of words; word, start and end of the hit ones; the items, sorted."""
        raw = (text or "").encode()
        words = normal_words(raw)
        if not words or not self.found:
            return len(words), [], []
        code, other, width = self.codes.get, self.other, self.width
        edge, items = None, set()
        for end, i in self.automaton.iter("".join([code(w, other) for w in words])):
            last, beside = divmod(end + 1, width)
            if beside:  # from the middle of a code
                continue
            if edge is None:
                edge = np.zeros(len(words) + 1, np.int64)
            n, names = self.found[i]
            edge[last - n] += 1
            edge[last] -= 1
            items.update(names)
        if edge is None:
            return len(words), [], []
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        begin, end = (x[hit].tolist() for x in _places(raw))
        return len(words), [{"word": w, "start": a, "end": b} for w, a, b in zip(hit.tolist(), begin, end, strict=True)], sorted(items)


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(broadcast, window: int) -> Matcher:
    """The automaton of a broadcast list, made once in a Python worker. Its key is what the list holds: an address can be taken by another list later."""
    items = broadcast.value
    key = (hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).digest(), window)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def passes(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of at most MOST_WORDS words, one list at a time. A longer item is cut into pieces which overlap by a window less a word, so that each of its windows is in one."""
    part, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()
    for name, text in rows.toLocalIterator():
        words = normal_words(text.encode())
        step = max(1, MOST_WORDS - window + 1)
        for i in range(0, max(1, len(words) - window + 1), step) if words else ():
            piece = b" ".join(words[i : i + step + window - 1]).decode()
            n = min(len(words) - i, step + window - 1)
            if part and size + n > MOST_WORDS:
                yield part
                part, size = [], 0
            part.append((name, piece))
            size += n
    yield part


def _scanned(docs: DataFrame, items: list[tuple[str, str]], window: int, only_hits: bool) -> DataFrame:
    """The columns of docs but text, n_words, hit, items; with only_hits of rows that have a hit."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        find = matcher(sent, window)
        for batch in batches:
            rows = [find.scan(x) for x in batch.column("text").to_pylist()]
            at = [i for i, r in enumerate(rows) if r[1] or not only_hits]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(at, pa.int64())) for c in kept),
                    pa.array([rows[i][0] for i in at], pa.int64()),
                    pa.array([rows[i][1] for i in at], pa.list_(pa.struct([("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([rows[i][2] for i in at], pa.list_(pa.string())),
                ],
                [*kept, "n_words", "hit", "items"],
            )

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{schema}, n_words long, hit {_HIT}, items array<string>")


def spans(hit: Column) -> Column:
    """array<struct<start, end>> of the runs of neighbouring hit words."""
    first = F.filter(hit, lambda x, i: (i == 0) | (F.try_element_at(hit, F.greatest(i, F.lit(1)))["word"] != x["word"] - 1))
    last = F.filter(hit, lambda x, i: (i == F.size(hit) - 1) | (F.try_element_at(hit, F.least(i + 2, F.size(hit)))["word"] != x["word"] + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), spans of each row of docs (doc_id, text).

    spans are start and end (exclusive) of the shared passages, in code points of the original text.
    doc_id may be of any type; texts may be of any length. A null text has no words; items without
    words or id are left aside, and several of one id count as one. Repeated rows come back as often,
    other columns are left aside, an empty table gives an empty one and an empty benchmark no hits.
    """
    small_batches(docs.sparkSession)
    docs = plain(docs, "doc_id", "text")
    lists = list(passes(benchmark, window))
    if len(lists) == 1:
        rows = _scanned(docs, lists[0], window, False)
    else:
        key = F.xxhash64("text").alias("_text")
        found = reduce(DataFrame.unionByName, (_scanned(docs.select("doc_id", key, "text"), part, window, True) for part in lists))
        found = found.groupBy("doc_id", "_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        every = _scanned(docs.select("doc_id", key, "text"), [], window, False).select("doc_id", "_text", "n_words")
        found = found.select(F.struct("doc_id", "_text").alias("_key"), F.struct("hit", "items").alias("_found"))
        rows = every.join(found, F.struct("doc_id", "_text").eqNullSafe(F.col("_key")), "left")
        rows = rows.select("doc_id", "n_words", *(F.coalesce(F.col(f"_found.{c}"), F.array().cast(t)).alias(c) for c, t in (("hit", _HIT), ("items", "array<string>"))))
    return rows.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", spans(F.col("hit")).alias("spans"))


def is_contaminated(n_hit, n_words):
    """The rule: at least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, in all their columns, that are not contaminated. They are not shuffled where one pass does; otherwise contaminated texts are told by hash."""
    spark = docs.sparkSession
    small_batches(spark)
    lists = list(passes(benchmark, window))
    if len(lists) > 1:
        key = F.xxhash64("text")
        found = contamination(docs.select(F.struct(key.alias("text"), F.length("text").alias("n")).alias("doc_id"), "text"), benchmark, window)
        gone = cut(found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("_gone")).distinct())
        return docs.join(gone, F.struct(key.alias("text"), F.length("text").alias("n")) == F.col("_gone"), "left_anti")
    sent = spark.sparkContext.broadcast(lists[0])

    def run(batches):
        find = matcher(sent, window)
        for batch in batches:
            rows = [find.scan(x) for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([not is_contaminated(len(hit), n) for n, hit, _ in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
