"""The two jobs: runs over growing copies, failures between writes, reruns, edge cases, the command line."""

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import corpus_refresh, turn_evidence
from jobs.common import main, stored
from lorespan.operators import chunking, retrieval

DOCS = "doc_id long, text string, lang string, source string"
FEW = {"min_chunk_words": 1, "chunk_words": 4, "delimiter": "\n"}


@pytest.fixture()
def places(tmp_path):
    return {"documents": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def add(spark, places, *rows):
    spark.createDataFrame([(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows], DOCS).coalesce(1).write.mode("append").parquet(places["documents"])


def now(spark, places):
    return sorted((r["chunk_id"], r["text"], r["lang"]) for r in corpus_refresh.current(spark, places["output"]).collect())


def fresh(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, raw string")
    from lorespan.settings import Settings

    return sorted((r["chunk_id"], r["text"], "en") for r in chunking.chunks(docs, Settings(min_chunk_words=1, chunk_words=4), "\n").collect())


def test_runs_take_only_what_is_new(spark, places):
    add(spark, places, (1, "a b c\nd e"), (2, "one"), (3, None))
    first = corpus_refresh.refresh(spark, **places, **FEW)
    assert first == {"read": 3, "without_id": 0, "changed": 3, "chunks": 3, "batches": 1}
    assert now(spark, places) == fresh(spark, [(1, "a b c\nd e"), (2, "one")])
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(places["output"]).rglob("*.parquet")}
    before = files()
    assert corpus_refresh.refresh(spark, **places, **FEW)["batches"] == 0 and files() == before
    # a new document, a changed one, one that is as before, one that lost its text
    add(spark, places, (4, "new here"), (1, "a b c\nchanged words now"), (2, "one"), (3, ""), (5, "x"))
    add(spark, places, (5, None))
    second = corpus_refresh.refresh(spark, **places, **FEW, files_per_batch=1)
    assert (second["batches"], second["read"], second["changed"]) == (2, 6, 4)
    assert now(spark, places) == fresh(spark, [(1, "a b c\nchanged words now"), (2, "one"), (4, "new here")])
    assert all(files()[p] == t for p, t in before.items())  # what stood there was not written again


def test_a_batch_that_failed_between_its_writes_runs_again(spark, places, monkeypatch):
    add(spark, places, (1, "a b"), (2, "c d"))
    corpus_refresh.refresh(spark, **places, **FEW)
    add(spark, places, (1, "other words"), (3, "e f"))
    cut, calls = chunking.chunks, []

    def fails(docs, *a, **k):
        calls.append(1)
        rows = cut(docs, *a, **k)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(f"{places['output']}/chunks")
        raise RuntimeError("lost")

    monkeypatch.setattr(chunking, "chunks", fails)
    with pytest.raises(Exception, match="lost"):
        corpus_refresh.refresh(spark, **places, **FEW)
    monkeypatch.undo()
    assert calls and now(spark, places) == fresh(spark, [(1, "a b"), (2, "c d")])  # its chunks lie there and don't count
    assert corpus_refresh.refresh(spark, **places, **FEW)["changed"] == 2
    assert now(spark, places) == fresh(spark, [(1, "other words"), (2, "c d"), (3, "e f")])
    assert stored(spark, f"{places['output']}/chunks", corpus_refresh.CHUNKS).count() == 4


def test_chunks_are_encoded_in_small_splits_and_one_value_a_vector(spark, places, monkeypatch):
    add(spark, places, *[(i, f"text number {i}") for i in range(40)])
    key, encoded, seen = "spark.sql.files.maxPartitionBytes", retrieval.encoded, []
    before = spark.conf.get(key)
    monkeypatch.setattr(retrieval, "encoded", lambda new, *a, **k: seen.append((new.sparkSession.conf.get(key), new.sparkSession)) or encoded(new, *a, **k))
    corpus_refresh.refresh(spark, **places, **FEW)
    assert [int(size) for size, _ in seen] == [corpus_refresh.SPLIT] and corpus_refresh.SPLIT < 128 << 20
    assert seen[0][1].conf.get(key) == before == spark.conf.get(key)
    written = spark.read.parquet(f"{places['output']}/encoded")
    assert dict(written.dtypes)["vec"] == "binary" and {len(r.vec) for r in written.collect()} == {4 * 512}


def test_a_batch_is_the_same_if_it_runs_twice(spark, places):
    docs = spark.createDataFrame([(1, "a b"), (1, "z"), (1, "z"), (None, "q"), (2, "c")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    from lorespan.settings import Settings

    few = Settings(min_chunk_words=1, chunk_words=4)
    for _ in range(2):
        got = corpus_refresh.take(docs, places["output"], 0, few, "\n")
        assert got == {"batch": 0, "read": 5, "without_id": 1, "changed": 2, "chunks": 2}
    assert now(spark, places) == [("1#c1", "z", None), ("2#c1", "c", None)]


def test_an_index_of_stored_batches_equals_one_made_anew(spark, places):
    """After documents are added, changed, emptied and left as they are, in several runs."""
    rnd = random.Random(4)
    text = lambda: "\n".join(" ".join(rnd.choice(["venue", "fees", "pune", "parking", "menu", "30"]) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(4)))
    queries = spark.createDataFrame([(1, "venue fee"), (2, "parking in pune"), (3, "menu menu 30")], "query_id long, text string")
    for _ in range(3):
        add(spark, places, *((i, text()) for i in rnd.sample(range(25), 12)))
        corpus_refresh.refresh(spark, **places, **FEW)
    kept, new = corpus_refresh.index(spark, places["output"]), retrieval.build(corpus_refresh.current(spark, places["output"]))
    for part in ("terms", "stats", "postings", "vectors"):
        assert sorted(map(str, getattr(kept, part).collect())) == sorted(map(str, getattr(new, part).collect())), part
    found = [sorted(map(str, retrieval.search(queries, x).collect())) for x in (kept, new)]
    assert found[0] == found[1] and len(found[0]) > 5
    # what an earlier run stored isn't made again
    encoded = stored(spark, f"{places['output']}/encoded", corpus_refresh.ENCODED)
    assert {r["batch"] for r in encoded.select("batch").distinct().collect()} == {0, 1, 2}
    assert encoded.count() == stored(spark, f"{places['output']}/chunks", corpus_refresh.CHUNKS).count()


def test_no_documents(spark, places):
    spark.createDataFrame([], DOCS).write.parquet(places["documents"])
    corpus_refresh.refresh(spark, **places)
    assert now(spark, places) == []


def test_one_frequent_document_meets_in_the_map_tasks(spark, places):
    docs = spark.range(0, 30000, 1, 6).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 5).alias("text"), F.lit("en").alias("lang"))
    from lorespan.settings import Settings

    got = corpus_refresh.take(docs, places["output"], 0, Settings(min_chunk_words=1), "\n")
    assert got["changed"] == docs.select("doc_id").distinct().count()


# --- evidence of turns

TURNS = [
    (1, 0, "user", "find a venue for 30 people in Pune and the catering menu"), (1, 1, "assistant", "Lake House"), (1, 2, "user", "make it shorter"), (1, 3, "user", "what about parking"),
    (2, 0, "user", "make it shorter"), (2, 1, "user", None), (2, 1, "user", None), (3, 0, "user", "zzz qqq"), (None, 0, "user", "lost"), (3, None, "user", "lost"), (4, 0, "system", "parking"),
]
HALLS = [(1, "Lake House is a venue in Pune for people", "halls"), (2, "catering menu of the season", "food"), (3, "parking near the venue", "halls"), (4, "parking near the venue", "halls"), (5, None, None), (None, "venue parking catering", "halls")]


def test_evidence_of_turns(spark, tmp_path):
    said, docs, out = (str(tmp_path / n) for n in ("said", "docs", "out"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(said)
    spark.createDataFrame(HALLS, "doc_id long, text string, source string").write.parquet(docs)
    got = []
    for _ in range(2):
        done = turn_evidence.evidence(spark, said, docs, out, buckets=3)
        got.append(sorted(map(str, stored(spark, out, turn_evidence.EVIDENCE).collect())))
        assert (done["turns_read"], done["turns_without_id"], done["documents_without_id"], done["suppressed"]) == (11, 2, 1, 1)
        assert done["rows_written"] == len(got[-1])
    assert got[0] == got[1]
    rows = {}
    for r in stored(spark, out, turn_evidence.EVIDENCE).orderBy("conv_id", "turn", "rank").collect():
        rows.setdefault((r["conv_id"], r["turn"]), []).append(r)
    assert sorted(rows) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0)]
    assert {r["doc_id"] for r in rows[1, 0]} >= {"1", "2"} and rows[1, 0][0]["n_sub_queries"] == 2
    assert [(r["route"], r["rank"], r["n_sub_queries"]) for r in rows[1, 2]] == [("suppressed", None, 0)]  # an answer stands before it
    assert rows[2, 0][0]["route"] == "searched" and rows[2, 1][0]["n_sub_queries"] == 0
    assert [r["doc_id"] for r in rows[1, 3]] == ["3"]  # of equal texts one
    assert [r["rank"] for r in rows[3, 0]] == [None]
    assert {r["bucket"] for v in rows.values() for r in v} == {0, 1, 2}


def test_no_turns(spark, tmp_path):
    said, docs, out = (str(tmp_path / n) for n in ("said", "docs", "out"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(said)
    spark.createDataFrame(HALLS, "doc_id long, text string, source string").write.parquet(docs)
    assert turn_evidence.evidence(spark, said, docs, out)["rows_written"] == 0


# --- the command line


def test_command_line(spark, tmp_path, places):
    add(spark, places, (1, "a b c\nd e"), (2, "one"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({**FEW, "output": places["output"]}))
    root = Path(__file__).resolve().parents[1]
    ran = subprocess.run(
        [sys.executable, "-m", "jobs.corpus_refresh", "--config", str(config), "--documents", places["documents"], "--checkpoint", places["checkpoint"]],
        cwd=root, capture_output=True, text=True, timeout=240, check=False,
    )
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "'read': 2" in ran.stderr and places["documents"] in ran.stderr
    assert now(spark, places) == fresh(spark, [(1, "a b c\nd e"), (2, "one")])
    for name, job in (("corpus_refresh", corpus_refresh.refresh), ("turn_evidence", turn_evidence.evidence)):
        given = json.loads((root / "jobs" / f"{name}.json").read_text())
        assert set(given) <= set(job.__kwdefaults__)
    with pytest.raises(SystemExit):
        main(corpus_refresh.refresh, corpus_refresh.PATHS, ["--documents", "x"])
