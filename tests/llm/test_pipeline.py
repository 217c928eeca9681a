"""The pipeline as a whole, stage by stage against what the stages promise."""

from collections import Counter
from pathlib import Path

import pytest

from lorespan.llm import decontam, jaccard, mixing, toxicity
from lorespan.llm.common import shared_checkpoints
from tests.llm.test_ops import brute_components, brute_hits, brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def cleaned(text):
    """Secrets of a text replaced by their kinds; overlapping spans together, by the first one's."""
    out, at = "", 0
    for start, _, end, kind in brute_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def files(spark):
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sorted(p.name for p in root.iterdir())


def test_nothing_is_left_behind(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared_checkpoints(spark)
    before = files(spark)
    assert jaccard.near_duplicates(docs).count() == 200
    after = set(files(spark)) - set(before)
    assert len(after) == 1 and not any(x.startswith("stage") for x in after)  # the result, which goes with the application
    before = files(spark)
    corpus_pipeline.run(spark, SF).count()
    left = [x for x in files(spark) if x not in before]
    assert not any(x.startswith("stage") for x in left)
    kept, = [x for x in left if x.startswith("pipeline")]
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert [p.name for p in (root / kept).iterdir()] == ["secrets"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_checkpoints(Session)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_id = {r.doc_id: r for r in docs.collect()}
    rows = {i: r.text for i, r in by_id.items()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    left = {i: t for i, t in rows.items() if scores[i] < toxicity.THRESHOLD}
    found = brute_components(sorted(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if found[i][1] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: brute_hits(t, items) for i, t in left.items()}
    left = {i: t for i, t in left.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken", "copy"]
    got = out.collect()
    # all that the stages leave goes into the mix; what it takes of each, brute force says below
    mixed = mixing.mix(spark.createDataFrame([(i, cleaned(t), by_id[i].lang, by_id[i].source, 0) for i, t in left.items()], docs.schema)).collect()
    assert {r.doc_id for r in mixed} == set(left)
    assert Counter(r.doc_id for r in got) == Counter({r.doc_id: r.copies for r in mixed if r.copies})
    for r in got:
        assert r.text == cleaned(left[r.doc_id])
        spans = brute_spans(left[r.doc_id])
        assert (r.text == left[r.doc_id]) == (not spans) and not brute_spans(r.text)
    copies, words = Counter(r.doc_id for r in got), Counter()
    for r in got:
        assert copies[r.doc_id] <= 2 and r.taken == copies[r.doc_id] * r.size
        words[r.source] += r.size
    for source, target in {(r.source, r.target) for r in got}:
        assert abs(words[source] - target) <= max(r.size for r in got if r.source == source)


def test_stages_keep_columns_and_stand_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == (4 if name == "ngram_jaccard" else 5)
        assert stage(spark, docs.limit(0), SF).count() == 0
    taken = Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert taken == want and taken[3] == 4
    assert jaccard.Similarity().width == 5 and decontam.WINDOW == 13
