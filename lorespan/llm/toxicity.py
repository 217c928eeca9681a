"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Model. From a bounded sample of labelled rows, tokens and their beginnings (PREFIXES letters, for
inflected forms) get the log-odds of occurring in toxic against other documents, smoothed by a
Dirichlet prior in the proportions of the whole sample. Those that are surely positive are kept,
and, at 0, longer ones seen in clean documents that begin with them. In a text a token scores as
its longest kept feature; a token without one, or at 0, scores minus DRIFT. Features are counted by
an aggregation, and only what is kept of them, and numbers of the sample's documents, reach the driver.

Search. All maximal scoring segments of a text are found in one pass over its positive tokens
(Ruzzo and Tompa). Under the background model the best segment of n tokens follows an extreme-value
law with parameters lambda (the root of the background's moment equation) and K (fitted to the
sample's clean texts, with tokens learned from the other half of it). A segment is significant where
its expected number in a clean text of that length is at most E_MOST.

Score. Segments are all that a score is made of. A segment's evidence is lambda S - log(K n). The
evidence of a text is that of its r best segments together by their sum statistic (Karlin and
Altschul), for the r that gives most. It and the best segment's alone, both as log(1 + x), go into a
logistic model, fitted across halves of the sample, too.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import Scratch, mix, plain, shingles, small_batches
from lorespan.llm.common import words as words_of
from lorespan.llm.decontam import normal_words

#: Labelled rows that the model is fitted on at most, of either label; the first by hash.
SAMPLE = 3200
#: Letters of the beginnings of words that count as features.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Features need this many standard errors and so much log-odds; a token scores at most so much.
SURE, LEAST, TOP = 3.0, 2.0, 6.0
#: Weight of the prior as a share of the sample; what another token takes from a segment; expected number of a significant segment.
PRIOR, DRIFT, E_MOST = 0.05, 0.1, 0.05
#: Scores of tokens remembered by a worker.
MEMORY = 200_000
THRESHOLD = 0.7


def features(word: bytes) -> list[str]:
    """The word and its beginnings, the longest first."""
    text = word.decode("utf-8", "replace")
    return ["=" + text, *(text[:n] for n in reversed(PREFIXES) if len(text) > n)]


class Scores(dict):
    """Token scores, computed when first asked for."""

    def __init__(self, odds: dict[str, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMORY:
            self.clear()
        best = next((self.odds[f] for f in features(word) if f in self.odds), 0.0)
        self[word] = best
        return best

    def hits(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Places and scores of the tokens over 0."""
        row = [self[w] for w in words]
        at = np.flatnonzero(np.array(row)).tolist() if row else []
        return at, [row[i] for i in at]


def segments(at: list[int], score: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, where the tokens `at` have these positive scores and all others -drift."""
    kept: list[list] = []  # first, last, sum before, sum after
    total, before = 0.0, -1
    for i, s in zip(at, score, strict=True):
        total -= drift * (i - before - 1)
        new = [i, i, total, total + s]
        total, before = new[3], i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(a, b, y - x) for a, b, x, y in kept]


def together(evidence: list[float]) -> float:
    """Minus the log of the chance that the sum of the r best of these normalised scores is so large in a clean text, for the r that makes most of it (each r at half the stake of the one before); 0 if none is over 0."""
    best, total = 0.0, 0.0
    for r, x in enumerate(sorted((x for x in evidence if x > 0), reverse=True), 1):
        total += x
        best = max(best, total - (r - 1) * log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r) - (r - 1) * log(2))
    return best


@dataclass
class Model:
    odds: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def evidence(self, score: float, n: int) -> float:
        """Minus the log of the expected number of segments as good in a clean text of n tokens."""
        return self.lam * score - log(self.k * max(n, 1))

    def inputs(self, found: list[float], n: int) -> tuple[float, float]:
        """What the score of a text of n tokens is made of: evidence of its segments' scores together, and of the best."""
        each = [self.evidence(s, n) for s in found]
        return float(np.log1p(together(each))), float(np.log1p(max(0.0, *each, 0.0)))

    def probability(self, every: float, best: float) -> float:
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-(a + b * every + c * best))))


def log_odds(counts: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """Of features (feature, toxic, clean: numbers of documents with it, of n1 toxic and n0 others), those that are surely likelier in toxic ones, and at 0 longer ones that clean documents have. Features of one toxic document alone tell nothing."""
    n1, n0 = max(1, n1), max(1, n0)
    prior = PRIOR * (n0 + n1)
    a = prior * (F.col("toxic") + F.col("clean")) / (n0 + n1)
    rows = counts.withColumn("x", F.col("toxic") + a).withColumn("y", F.col("clean") + a)
    delta = F.log(F.col("x") / F.greatest(n1 + prior - F.col("x"), F.lit(0.5))) - F.log(F.col("y") / F.greatest(n0 + prior - F.col("y"), F.lit(0.5)))
    sure = rows.where("toxic > 1").withColumn("delta", delta).where((F.col("delta") > LEAST) & (F.col("delta") >= SURE * F.sqrt(1 / F.col("x") + 1 / F.col("y"))))
    kept = {r["feature"]: min(TOP, r["delta"]) for r in sure.select("feature", "delta").collect()}
    beginnings = [f for f in kept if not f.startswith("=")]
    if not beginnings:
        return kept
    word = F.regexp_replace("feature", "^=", "")
    begins = F.lit(False)
    for n in PREFIXES:
        if own := [b for b in beginnings if len(b) == n]:
            begins = begins | F.substring(word, 1, n).isin(own)
    longer = (r["feature"] for r in counts.where("clean > 0").where(begins).select("feature").toLocalIterator())
    return kept | {f: 0.0 for f in longer if f not in kept and any(f.removeprefix("=")[:n] in kept for n in PREFIXES)}


def _lambda(share: float, gain: float, drift: float) -> float:
    """The positive root of share * exp(l * gain) + (1 - share) * exp(-l * drift) = 1."""
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if share * np.exp(mid * gain) + (1 - share) * np.exp(-mid * drift) > 1 else (mid, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _names(raw: bytes) -> list[int]:
    """Least hashes of a text's shingles: near copies share one of them."""
    data = np.frombuffer(raw, np.uint8)
    hashes = shingles(words_of(data, np.array([0, len(data)]))[0], 4)
    return [int(mix(hashes ^ np.uint64(s + 1)).min() >> np.uint64(4)) * 8 + s for s in range(6)] if len(hashes) else [-1]


def originals(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, toxic, text) that are no near copies of earlier ones (by hash): they share none of a few least hashes of shingles."""

    def run(batches):
        for batch in batches:
            names = [_names((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.list_(pa.int64()))], ["doc_id", "names"])

    named = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, names array<long>").select("doc_id", F.xxhash64("doc_id", F.lit("order")).alias("at"), F.explode("names").alias("name"))
    first = named.groupBy("name").agg(F.min(F.struct("at", "doc_id"))["doc_id"].alias("first"), F.collect_set("doc_id").alias("ids"))
    later = first.select(F.explode(F.array_remove("ids", F.col("first"))).alias("doc_id")).distinct()
    return rows.join(later, "doc_id", "left_anti")


def _counted(rows: DataFrame) -> DataFrame:
    """feature and, of the halves 0 and 1, the numbers of toxic and clean documents with it."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for half, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("half", "toxic", "text")), strict=True):
                seen.update((half, toxic, f) for f in {f for w in set(normal_words((text or "").encode())) for f in features(w)})
            keys = list(seen)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] for k in keys], pa.int64())], ["half", "toxic", "feature", "n"])

    counted = rows.select("half", "toxic", "text").mapInArrow(run, "half int, toxic int, feature string, n long")
    cell = lambda half, toxic: F.coalesce(F.sum(F.when((F.col("half") == half) & (F.col("toxic") == toxic), F.col("n"))), F.lit(0))
    return counted.groupBy("feature").agg(cell(0, 1).alias("t0"), cell(0, 0).alias("c0"), cell(1, 1).alias("t1"), cell(1, 0).alias("c1"))


def _searched(rows: DataFrame, odds: list[dict[str, float]]) -> dict[str, list]:
    """toxic, size, gains and scores of segments of each document, by tokens that the other half taught."""

    def run(batches):
        scores = [Scores(x) for x in odds]
        for batch in batches:
            out = []
            for half, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("half", "toxic", "text")), strict=True):
                words = normal_words((text or "").encode())
                at, score = scores[1 - half].hits(words)
                out.append((toxic, len(words), len(score), sum(score), [s for *_, s in segments(at, score)]))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["toxic", "size", "n_gains", "gains", "scores"])

    found = rows.select("half", "toxic", "text").mapInArrow(run, "toxic int, size long, n_gains long, gains double, scores array<double>")
    return found.toArrow().to_pydict()


def fit(rows: DataFrame) -> Model:
    """A model of labelled rows (doc_id, toxic, text); of near copies the first counts. Without toxic or without clean rows it scores all alike."""
    with Scratch(rows.sparkSession) as scratch:
        own = scratch.keep(originals(rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")))
        n = {(r["half"], r["toxic"]): r["count"] for r in own.groupBy("half", "toxic").count().collect()}
        n1, n0 = (n.get((0, y), 0) + n.get((1, y), 0) for y in (1, 0))
        if not n1 or not n0:
            share = (n1 + 0.5) / (n1 + n0 + 1)
            return Model({}, weights=(float(np.log(share / (1 - share))), 0.0, 0.0))
        counts = scratch.keep(_counted(own))
        model = Model(log_odds(counts.select("feature", (F.col("t0") + F.col("t1")).alias("toxic"), (F.col("c0") + F.col("c1")).alias("clean")), n1, n0))
        halves = [log_odds(counts.select("feature", F.col(f"t{h}").alias("toxic"), F.col(f"c{h}").alias("clean")), n.get((h, 1), 0), n.get((h, 0), 0)) for h in (0, 1)]
        found = _searched(own, halves)
    # in order, so that sums don't depend on where rows were scored
    rows_ = sorted(zip(*(found[c] for c in ("toxic", "size", "n_gains", "gains", "scores")), strict=True))
    clean = [r for r in rows_ if not r[0]]
    n_gains, gains = sum(r[2] for r in clean), sum(r[3] for r in clean)
    model.lam = _lambda(max(n_gains, 1) / max(sum(r[1] for r in clean), 2), gains / n_gains if n_gains else TOP / 2, DRIFT)
    model.k = max(1e-6, len(clean) / max(1e-9, sum(max(1, r[1]) * np.exp(-model.lam * max(r[4], default=0.0)) for r in clean)))
    model.weights = _logistic(np.array([model.inputs(r[4], r[1]) for r in rows_]), np.array([r[0] for r in rows_], float))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled rows of either label, the first by hash; held-out rows are never among them. Of several labels of a document the highest counts, of several texts the least. doc_id must be an integer, or cast to one that fits 64 bits."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    small_batches(docs.sparkSession)
    return fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text"))


def _result(model: Model, text: str, scores: Scores) -> tuple[float, list[dict]]:
    words = normal_words((text or "").encode())
    found = segments(*scores.hits(words))
    p = model.probability(*model.inputs([s for *_, s in found], len(words)))
    least = -log(E_MOST)
    return p, [{"first_word": a, "last_word": b, "score": s} for a, b, s in found if model.evidence(s, len(words)) >= least]


def score(text: Column, model: Model) -> Column:
    """struct<score double, passages array<struct<first_word, last_word, score>>> of a text column; null is empty."""

    passage = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf("score double, passages array<struct<first_word:int,last_word:int,score:double>>")
    def run(texts: pa.Array) -> pa.Array:
        scores = _SCORES.setdefault("now", Scores({}))
        if scores.odds is not model.odds and scores.odds != model.odds:
            scores = _SCORES["now"] = Scores(model.odds)
        rows = [_result(model, t, scores) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in rows], pa.float64()), pa.array([s for _, s in rows], pa.list_(passage))], ["score", "passages"])

    return run(text)


_SCORES: dict[str, Scores] = {}


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), passages of each row of docs (doc_id, text).

    passages are the significant ones, by first and last word (words as in normal_words), in order.
    doc_id may be of any type, texts of any length. Null and empty texts get the score of a text
    without toxic words. Repeated rows come back as often, and equal texts score alike; other columns
    are left aside; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = plain(docs, "doc_id", "text").withColumn("x", score(F.col("text"), model))
    return rows.select("doc_id", "x.score", "x.passages")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, in all their columns, that score below threshold. They are not shuffled."""
    small_batches(docs.sparkSession)
    return docs.where(score(F.col("text"), model)["score"] < threshold)
