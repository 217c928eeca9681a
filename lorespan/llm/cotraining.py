"""Document quality by co-training of two views.

The text view sees a text alone: its words, hashed, shares of kinds of characters, repetition of words
and runs. The metadata view sees language, source and length alone. Each is a logistic model over
binned columns; words, and languages and sources as they are, come in as a column of evidence, the mean
log-odds of good against bad rows that have them, to which a row that is learned from adds nothing
itself. Over rounds, each view labels the documents of which it is surest, of all unlabelled ones of the
corpus, if its calibrated probability is sure enough, and the other view learns from them. At the end
both views are calibrated on out-of-fold scores of the labelled sample and a small logistic model
combines them. All documents are scored in one pass without a shuffle.

Only rows of features reach the driver: those of the labelled sample, which is bounded, and GIVEN
documents a class, view and round. Features of the unlabelled documents are kept as Parquet between
rounds; a task hands on its own surest GIVEN, and the surest of all are taken from those in two steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import Scratch, chunks, perhaps, small_batches, words

#: Labelled rows that the model is fitted on at most, the first by hash.
LABELLED = 6000
#: Rounds; labels that a view gives of a class and round at most; how sure it must be of them.
ROUNDS, GIVEN, SURE = 4, 200, 0.97
BINS, FOLDS, RIDGE = 10, 5, 1.0
#: Buckets of hashed words.
BUCKETS = 1 << 12
#: In how many parts the surest of all tasks are compared first.
SLICES = 256
THRESHOLD = 0.5
_KINDS = ("space", "newline", "upper", "lower", "digit", "stop", "comma", "bang", "bar", "symbol", "other", "wide")
_CLASS = np.array([
    1 if c == 10 else 0 if c in (9, 11, 12, 13, 32) else 2 if 65 <= c < 91 else 3 if 97 <= c < 123 else 4 if 48 <= c < 58
    else 5 if c in b".:;?" else 6 if c == 44 else 7 if c == 33 else 8 if c == 124 else 9 if c in b"#$%&*@^~<>{}[]\\=+_" else 11 if c >= 128 else 10
    for c in range(256)
])
_RATIOS = ("different words", "different pairs", "different triples", "repeated next", "commonest word", "word length", "two symbols")

def text_features(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row for each text: shares of byte classes, then ratios of words; and the buckets of its different words. Of an empty text all are 0, and it has none."""
    out = np.zeros((len(column), len(_KINDS) + len(_RATIOS)))
    buckets = [np.zeros(0, np.uint16)] * len(column)
    for a, b, data, offsets in chunks(column):
        hashes, at = words(data, offsets)
        kind = _CLASS[data]
        for i in range(b - a):
            own, h = kind[offsets[i] : offsets[i + 1]], hashes[at[i] : at[i + 1]]
            if not len(own) or not len(h):
                continue
            row = out[a + i]
            row[: len(_KINDS)] = np.bincount(own, minlength=len(_KINDS)) / len(own)
            different, counts = np.unique(h, return_counts=True)
            buckets[a + i] = np.unique((different % np.uint64(BUCKETS)).astype(np.uint16))
            with np.errstate(over="ignore"):
                pairs = h[:-1] * np.uint64(3) + h[1:]
                triples = pairs[:-1] * np.uint64(5) + h[2:]
            odd = np.isin(own, (7, 8, 9))
            row[len(_KINDS) :] = (
                len(counts) / len(h),
                len(np.unique(pairs)) / max(1, len(pairs)),
                len(np.unique(triples)) / max(1, len(triples)),
                float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0,
                counts.max() / len(h),
                len(own) / len(h),
                float((odd[1:] & odd[:-1]).mean()) if len(odd) > 1 else 0.0,
            )
    return out, buckets


@lru_cache(maxsize=1 << 16)
def _name(value: str | None) -> int:
    return 0 if value is None else int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") >> 1 | 1


@dataclass
class Tokens:
    """Rows of numbered tokens, one after the other."""

    ids: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Tokens:
        return cls(np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)]), np.cumsum([len(r) for r in rows], dtype=np.int64))

    def __len__(self) -> int:
        return len(self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(np.r_[0, self.ends]))

    def take(self, at: np.ndarray) -> Tokens:
        at = np.arange(len(self))[at]
        starts = np.r_[0, self.ends[:-1]] if len(self) else self.ends
        return Tokens.of([self.ids[starts[i] : self.ends[i]] for i in at])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.r_[self.ids, other.ids], np.r_[self.ends, other.ends + (self.ends[-1] if len(self) else 0)])


@dataclass
class Rows:
    """What a view sees of some documents: numbers, and groups of tokens."""

    numbers: np.ndarray
    groups: list[Tokens]

    def __len__(self) -> int:
        return len(self.numbers)

    def take(self, at) -> Rows:
        return Rows(self.numbers[at], [g.take(at) for g in self.groups])

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.r_[self.numbers, other.numbers], [a + b for a, b in zip(self.groups, other.groups, strict=True)])


def text_rows(column: pa.Array) -> Rows:
    numbers, buckets = text_features(column)
    return Rows(numbers, [Tokens.of(buckets)])


def meta_rows(lang: list, source: list, n_chars: list) -> Rows:
    """Log length (-1 for null); language; source. Null is a value of its own."""
    length = np.array([-1.0 if n is None else np.log1p(max(0, n)) for n in n_chars], float).reshape(-1, 1)
    return Rows(length, [Tokens.of([[_name(x)] for x in values]) for values in (lang, source)])


@dataclass
class Evidence:
    """Log-odds of tokens; of a row, their mean."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def learn(self, tokens: Tokens, y: np.ndarray) -> np.ndarray:
        """Learns from rows with labels; the evidence of each of them by all the others."""
        self.known, at = np.unique(tokens.ids, return_inverse=True)
        label = y[tokens.rows()]
        good = np.bincount(at, label, len(self.known))
        bad = np.bincount(at, 1 - label, len(self.known))
        n1, n0 = y.sum(), (1 - y).sum()
        part = lambda c, n: np.log((c + 1) / (n + 2))
        self.odds = part(good, n1) - part(bad, n0)
        others = np.where(label == 1, (part(np.maximum(good - 1, 0), max(n1 - 1, 0)) - part(bad, n0))[at], (part(good, n1) - part(np.maximum(bad - 1, 0), max(n0 - 1, 0)))[at]) if len(at) else np.zeros(0)
        return self._means(tokens, others)

    def of(self, tokens: Tokens) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(tokens))
        at = np.minimum(np.searchsorted(self.known, tokens.ids), len(self.known) - 1)
        return self._means(tokens, np.where(self.known[at] == tokens.ids, self.odds[at], 0.0))

    @staticmethod
    def _means(tokens: Tokens, values: np.ndarray) -> np.ndarray:
        n = np.diff(np.r_[0, tokens.ends])
        return np.bincount(tokens.rows(), values, len(tokens)) / np.maximum(n, 1)


@dataclass
class View:
    """Logistic regression over one-hot bins of numbers and evidence."""

    evidence: list[Evidence] = field(default_factory=list)
    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: tuple[float, float] = (0.0, 1.0)

    def design(self, columns: np.ndarray) -> np.ndarray:
        blocks = [np.ones((len(columns), 1))]
        for i, edge in enumerate(self.edges):
            blocks.append((np.searchsorted(edge, columns[:, i], "right")[:, None] == np.arange(len(edge) + 1)).astype(float))
        return np.concatenate(blocks, axis=1)

    def fit(self, rows: Rows, y: np.ndarray) -> None:
        self.evidence = [Evidence() for _ in rows.groups]
        columns = np.c_[rows.numbers, *(e.learn(g, y) for e, g in zip(self.evidence, rows.groups, strict=True))]
        self.edges = [np.unique(np.quantile(columns[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(columns.shape[1])]
        self.weights = logistic(self.design(columns), y, RIDGE)

    def raw(self, rows: Rows) -> np.ndarray:
        if not self.edges:  # nothing was learned
            return np.zeros(len(rows))
        return self.design(np.c_[rows.numbers, *(e.of(g) for e, g in zip(self.evidence, rows.groups, strict=True))]) @ self.weights

    def log_odds(self, rows: Rows) -> np.ndarray:
        return self.scale[0] + self.scale[1] * self.raw(rows)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved where they would not go down; the first column isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + (keep * v * v).sum() / 2)

    now = loss(w)
    for _ in range(40):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (p - y) + keep * w)
        for _ in range(20):
            if (new := loss(w - step)) <= now:
                break
            step = step / 2
        w, before, now = w - step, now, min(now, new)
        if before - now < 1e-8 * max(1.0, abs(now)):
            break
    return w


def _folds(rows: Rows, y: np.ndarray, more: Rows, more_y: np.ndarray) -> np.ndarray:
    """Out-of-fold scores; pseudo-labelled rows are in every fold's training part."""
    out, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for i in range(FOLDS):
        part = View()
        part.fit(rows.take(fold != i) + more, np.r_[y[fold != i], more_y])
        out[fold == i] = part.raw(rows.take(fold == i))
    return out


@dataclass
class Model:
    text: View
    meta: View
    weights: tuple[float, ...] = (0.0, 1.0, 0.0)

    def score(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probabilities of good quality."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return sigmoid(self.weights[0] + self.weights[1] * a + self.weights[2] * b), sigmoid(a), sigmoid(b)


@dataclass
class Given:
    """Pseudo-labelled rows that a view got from the other one."""

    keys: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    rows: Rows | None = None

    def add(self, keys: list[int], labels: list[int], rows: Rows) -> None:
        self.keys, self.labels = self.keys + keys, self.labels + labels
        self.rows = rows if self.rows is None else self.rows + rows


def cotrain(known: tuple[Rows, Rows], y: np.ndarray, surest, rounds: int = ROUNDS) -> Model:
    """A model of the text and metadata rows of labelled documents.

    surest(views, given) has, of either view, the (keys, labels, rows of the other view) of the
    unlabelled documents that it is surest of, without those that the other view was given already.
    """
    views, given = (View(), View()), (Given(), Given())
    if len(np.unique(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        for view in views:
            view.scale = (float(np.log(share / (1 - share))), 1.0)
        return Model(*views)
    for step in range(rounds + 1):
        oof = []
        for view, rows, own in zip(views, known, given, strict=True):
            more = rows.take(np.zeros(0, np.int64)) if own.rows is None else own.rows
            more_y = np.array(own.labels, float)
            scores = _folds(rows, y, more, more_y)
            view.scale = tuple(logistic(np.c_[np.ones(len(y)), scores], y, 1e-3).tolist())
            view.fit(rows + more, np.r_[y, more_y])
            oof.append(view.scale[0] + view.scale[1] * scores)
        if step < rounds:
            for i, found in enumerate(surest(views, given)):
                if found[0]:
                    given[1 - i].add(*found)
    weights = logistic(np.c_[np.ones(len(y)), *oof], y, RIDGE)
    return Model(*views, tuple(weights.tolist()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


_SEEN = "lang string, source string, n_chars long, numbers array<double>, buckets binary"


def _featured(docs: DataFrame) -> DataFrame:
    """The columns of docs, with numbers and buckets in place of text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            numbers, buckets = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(numbers), pa.list_(pa.float64())), pa.array([b.tobytes() for b in buckets], pa.binary())], [*kept, "numbers", "buckets"])

    return docs.mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", numbers array<double>, buckets binary")


def _views(columns: dict[str, list]) -> tuple[Rows, Rows]:
    """What both views see of rows (lang, source, n_chars, numbers, buckets)."""
    numbers = np.array(columns["numbers"], float).reshape(-1, len(_KINDS) + len(_RATIOS))
    return Rows(numbers, [Tokens.of([np.frombuffer(b, np.uint16) for b in columns["buckets"]])]), meta_rows(columns["lang"], columns["source"], columns["n_chars"])


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def surest_of(features: DataFrame, views: tuple[View, View], given: tuple[Given, Given], most: int = GIVEN) -> DataFrame:
    """view, label, sure and the row, of the rows of features (key, and _SEEN) that each view is surest of: at least SURE, at most `most` of a view and label, of equals the least keys; without those whose keys the other view has."""
    has = [np.sort(np.array(given[1 - i].keys, np.int64)) for i in (0, 1)]
    least = float(np.log(SURE / (1 - SURE)))
    names = [x.split()[0] for x in _SEEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for i, (view, rows) in enumerate(zip(views, _views(columns), strict=True)):
                z = np.round(view.log_odds(rows), 6)  # so that equal rows are equal wherever they are scored
                free = ~np.isin(keys, has[i])
                for label, sure in ((1, z), (0, -z)):
                    at = np.flatnonzero(free & (sure >= least))
                    at = at[np.lexsort((keys[at], -sure[at]))][:most]
                    if len(at):
                        new = pa.Table.from_batches([batch.take(pa.array(at))]).append_column("sure", pa.array(sure[at]))
                        old = best.get((i, label))
                        both = new if old is None else pa.concat_tables([old, new])
                        best[i, label] = both.sort_by([("sure", "descending"), ("key", "ascending")]).slice(0, most)
        for (i, label), rows in best.items():
            for part in rows.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int32()), pa.array([label] * len(part), pa.int32()), *(part.column(c) for c in ("sure", "key", *names))], ["view", "label", "sure", "key", *names])

    rows = features.select("key", *names).mapInArrow(run, f"view int, label int, sure double, key long, {_SEEN}")
    order = (F.col("sure").desc(), F.col("key"), F.col("n_chars"))
    for by in (("view", "label", "slice"), ("view", "label")):
        rows = rows.withColumn("slice", F.pmod("key", F.lit(SLICES))).withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most).drop("n", "slice")
    return rows


def _unlabelled(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among marks (distinct). Texts stay where they are, but for a few that a bitmap takes for labelled ones."""
    flagged = perhaps(marks, rows, "doc_id")
    taken = flagged.where("_perhaps").drop("_perhaps")
    wrongly = taken.select("doc_id").distinct().join(marks, "doc_id", "left_anti")
    back = perhaps(wrongly, taken, "doc_id").where("_perhaps").drop("_perhaps").join(wrongly, "doc_id", "left_semi")
    return flagged.where("not _perhaps").drop("_perhaps").unionByName(back)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """A model of at most so many labelled documents and of all unlabelled ones; held-out labels are never read.

    Of several labels of a document the highest counts, of several rows the least by text, language,
    source and length. Of repeated rows without label each is a row of its own. Rows without doc_id are
    left aside.
    """
    small_batches(docs.sparkSession)
    order = (F.xxhash64("doc_id", F.lit("quality")), "doc_id")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = marks.where(~held_out(F.col("doc_id"))).orderBy(*order).limit(labelled)
    rows = _columns(docs).where("doc_id is not null")
    sample = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x"))
    found = _featured(sample.select("doc_id", "quality", "x.*")).orderBy(*order).collect()
    y = np.array([r["quality"] for r in found], float)
    names = [x.split()[0] for x in _SEEN.split(", ")]
    seen = _views({c: [r[c] for r in found] for c in names})
    with Scratch(docs.sparkSession) as scratch:
        free = _unlabelled(rows, scratch.cut(marks.select("doc_id"))) if len(np.unique(y)) == 2 else rows.limit(0)
        features = scratch.keep(_featured(free.select(F.xxhash64(*rows.columns).alias("key"), *(c for c in rows.columns if c != "doc_id"))))

        def surest(views, given):
            new = surest_of(features, views, given).orderBy("view", "label", F.col("sure").desc(), "key", "n_chars").collect()
            out = []
            for i in (0, 1):
                own = [r for r in new if r["view"] == i]
                out.append(([r["key"] for r in own], [r["label"] for r in own], _views({c: [r[c] for r in own] for c in names})[1 - i]))
            return out

        return cotrain(seen, y, surest)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_score, meta_score (0 to 1, higher: better) of each row of docs (doc_id, text, lang, source, n_chars).

    Null and empty texts, null languages, sources and lengths are values of their own; texts may be of
    any length, doc_id of any type. Repeated rows come back as often, and equal ones score alike; other
    columns are left aside; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            meta = meta_rows(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            scores = model.score(text_rows(batch.column("text")), meta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.round(s, 12)) for s in scores)], ["doc_id", "score", "text_score", "meta_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _columns(docs).mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double")
