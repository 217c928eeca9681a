"""Speech to answers: look-ups while people speak, messages of sessions, streams, run logs."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from lorespan.operators import chunking, evaluation
from lorespan.operators import retrieval as rt
from lorespan.plans import live, telemetry
from lorespan.plans import turns as tn
from lorespan.settings import DEFAULT, Settings
from lorespan.sources import corpus
from lorespan.streaming import controller as ct
from tests.test_engine import BOTH, FOOD, HALLS

MESSAGES = "session_id string, seq int, t double, kind string, text string, is_final boolean, silence_s double"


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([("Hall", HALLS), ("Food", FOOD)], "doc_id string, raw string")
    return rt.build(chunking.chunks(docs))


def said(session, start, text, ending="end"):
    """A turn in groups of three words, and how it ends."""
    words = text.split()
    rows = [(session, start + i, (start + i) * 0.3, "chunk", " ".join(words[3 * i : 3 * i + 3]), False, 0.0) for i in range(-(-len(words) // 3))]
    return [*rows, (session, start + len(rows), (start + len(rows)) * 0.3, ending, "", False, 0.0)]


def test_look_ups_begin_before_a_turn_ends_and_are_used(spark, index):
    transcript = corpus.spoken(spark.createDataFrame([("s", 1, BOTH)], "session_id string, turn_id long, utterance string"))
    decided = ct.decisions(transcript)
    spoken = tn.speculate(decided, index).cache()
    end = ct.utterances(decided).first()
    rows = spoken.orderBy("prov_pos").collect()
    assert rows and all(r["at"] < end.ended_at for r in rows) and [r.prov_pos for r in rows] == list(range(len(rows)))
    asked = spark.createDataFrame([("s:1", [rows[0].query, "catering menu"])], "turn_id string, sub_queries array<string>")
    hits, reused = tn.look_up_after(asked, spoken, index)
    got = hits.collect()
    # the query that was looked up is not searched again; its results are those of a search
    assert reused.collect()[0].n_reused == 1 and {r.calls for r in got if r.query == rows[0].query and r.sq_pos < 2} == {0} and {r.calls for r in got if r.query == "catering menu"} == {DEFAULT.calls}
    again = {(r.rank, r.chunk_id) for r in tn.look_up(asked, index).where(F.col("query") == rows[0].query).collect()}
    assert {(r.rank, r.chunk_id) for r in got if r.query == rows[0].query and r.sq_pos < 2} == again
    # with all that was looked up, the answer is the one without, for fewer calls
    turns = spark.createDataFrame([("s:1", "s", 1, BOTH)], "turn_id string, session_id string, turn long, utterance string")
    plain, quick = tn.answer_sessions(turns, index).first(), tn.answer_sessions(turns, index, spoken=spoken).first()
    assert plain.answer == quick.answer != "" and quick.calls < plain.calls and set(plain.retrieved) <= set(quick.retrieved)


def test_results_that_nothing_used_come_last_and_once(spark, index):
    spoken = spark.createDataFrame([("t", 0, 0.3, "menu", [("Food#c1", 0.5)], 2), ("t", 1, 0.6, "menu again", [("Food#c1", 0.4)], 2)], "turn_id string, prov_pos int, at double, query string, found array<struct<chunk_id:string,score:double>>, calls int")
    asked = spark.createDataFrame([("t", ["cancellation rules in Pune"])], "turn_id string, sub_queries array<string>")
    hits, reused = tn.look_up_after(asked, spoken, index)
    late = [(r.sq_pos, r.query, r.chunk_id) for r in hits.collect() if r.sq_pos > 0]
    found = {r.chunk_id for r in hits.where("sq_pos = 0").collect()}
    assert reused.count() == 0 and late == ([] if "Food#c1" in found else [(1, "menu", "Food#c1")])


def test_places_come_from_requests_for_them(spark):
    rows = [("t", 0, "a venue in Pune for 30 people", 1, "c", "In Pune: Orchid Hall seats 60 people. Lake House seats 20 people.", 0.9, 2), ("t", 1, "parking", 1, "c", "Big Barn seats 90 people.", 0.9, 2)]
    got = tn.found_places(spark.createDataFrame(rows, tn.HITS)).first()
    assert got.places == ["Orchid Hall"]


def test_messages_open_and_close_turns(spark):
    rows = [*said("a", 0, "what is the parking like near the river"), *said("a", 10, "and now something else", "reset"), *said("a", 20, "hello there"), ("b", 0, 0.0, "ping", None, False, 0.0), ("b", 1, 0.1, "end", None, False, 0.0)]
    rows += [("c", 0, 0.0, "chunk", "first words", False, 0.0), ("c", 1, 0.5, "barge_in", "Stop that now", False, 0.0), ("c", 2, 1.0, "utterance", "  ", False, 0.0), ("c", 3, 1.5, "replace", "heard anew", False, 0.0), ("c", 4, 2.0, "chunk", "in full", True, 0.0)]
    got = ct.live_turns(spark.createDataFrame(rows, MESSAGES)).orderBy("session_id", "seq", "decision").collect()
    of = lambda s: [(r.turn_id, r.decision, r.buffer) for r in got if r.session_id == s]
    assert of("a")[3] == (1, "retrieve", "what is the parking like near the river") and ("reset" in [d for _, d, _ in of("a")]) and (2, "dropped", "and now something else") in of("a")
    assert of("a")[-1] == (3, "retrieve", "hello there") and of("b") == [(0, "pong", "")]
    assert of("c") == [(1, "wait", "first words"), (1, "dropped", "first words"), (2, "retrieve", "Stop that now"), (3, "wait", "heard anew"), (3, "retrieve", "heard anew in full")]


def test_live_sessions_are_answered_and_reset(spark, index):
    rows = [*said("a", 0, BOTH), *said("a", 20, "actually make it 50 people"), *said("a", 40, "make it shorter"), *said("b", 0, BOTH), ("b", 30, 9.0, "reset", None, False, 0.0), *said("b", 40, "make it shorter"), *said("c", 0, "never ends")[:-1]]
    answers, states, decided = live.answer_live(spark.createDataFrame(rows, MESSAGES), index)
    got = {r.turn_id: r for r in answers.collect()}
    assert {k: r.kind for k, r in got.items()} == {"a:1": "fresh", "a:2": "refine", "a:3": "suppressed", "b:1": "fresh", "b:2": "fresh"}
    assert [got[f"a:{i}"].answer_version for i in (1, 2, 3)] == [1, 2, 3] and got["b:2"].answer_version == 1
    assert {r.session_id: r.answer_version for r in states.collect()} == {"a": 3, "b": 1}
    # the same, in two parts with the states in between
    first, second = [r for r in rows if r[1] < 20 or r[0] != "a"], [r for r in rows if r[1] >= 20 and r[0] == "a"]
    _, held, _ = live.answer_live(spark.createDataFrame(first, MESSAGES), index)
    later = {r.kind: r for r in live.answer_live(spark.createDataFrame(second, MESSAGES), index, states=held)[0].collect()}
    assert set(later) == {"refine", "suppressed"} and later["suppressed"].answer == got["a:3"].answer
    # every stage of every turn reports
    spoken = tn.speculate(decided.where("decision = 'provisional_retrieve'"), index)
    events = telemetry.turn_events(answers, decided, spoken, "r1").cache()
    names = {(r.event, json.loads(r.payload).get("turn_id")) for r in events.collect()}
    for turn, r in got.items():
        wanted = {"utterance_end", "turn_classified", "turn_complete"} | (set() if r.kind == "suppressed" else {"sub_query_dispatched", "retrieval_started", "fusion_done", f"answer_v{r.answer_version}"})
        assert wanted <= {e for e, t in names if t == turn}
    assert events.where("event = 'controller_decision'").count() == decided.where("decision not in ('dropped', 'reset', 'pong')").count()
    assert events.where("run_id != 'r1' or session_id is null").count() == 0


def test_a_stream_of_messages_is_answered(spark, index, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    parts = ([*said("a", 0, BOTH)], [*said("a", 20, "actually make it 50 people")], [("a", 40, 12.0, "reset", None, False, 0.0), *said("b", 0, "make it shorter")])
    (tmp_path / "in").mkdir()
    messages = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).json(source)
    for part in parts:
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").json(source)
        live.serve(messages, index, folder, expire=False).awaitTermination(200)
    got = {r.turn_id: (r.kind, r.answer_version) for r in spark.read.parquet(f"{folder}/answers/batch=*").collect()}
    assert got == {"a:1": ("fresh", 1), "a:2": ("refine", 2), "b:1": ("fresh", 1)}
    assert {r.session_id: r.answer_version for r in live.latest_states(spark, folder).collect()} == {"b": 1}


def test_a_batch_reads_a_whole_and_the_batches_since(spark, index, tmp_path, monkeypatch):
    """Five batches, in which turns go on over several; what lies before the last whole may be gone, and a batch may run twice."""
    folder = tmp_path / "out"
    rows = [*said("a", 0, BOTH), *said("b", 0, "what is the parking like near the river"), *said("a", 20, "actually make it 50 people"), *said("c", 0, "catering for events is ordered a week ahead"), ("b", 40, 9.0, "reset", None, False, 0.0), *said("b", 50, "make it shorter"), *said("d", 0, "never ends in this")[:-1]]
    answers, states, decided = live.answer_live(spark.createDataFrame(rows, MESSAGES), index)
    part = F.when(F.col("session_id").isin("a", "b"), F.when(F.col("seq") < 2, 0).when(F.col("seq") < 20, 1).when(F.col("seq") < 22, 2).otherwise(4)).otherwise(F.when(F.col("seq") < 1, 1).otherwise(3))
    decided = decided.withColumn("part", part).cache()
    read, plain = [], live._batches
    monkeypatch.setattr(live, "_batches", lambda spark, folder, name, schema, numbers: read.append((name, list(numbers))) or plain(spark, folder, name, schema, numbers))
    for n in range(5):
        del read[:]
        if n == 4:
            for name in ("decisions", "states"):
                for gone in (0, 1):
                    shutil.rmtree(folder / name / f"batch={gone}")
        for _ in range(2 if n == 3 else 1):
            live.take(decided.where(F.col("part") == n).drop("part"), n, index, str(folder), now=None, every=2)
        assert all(len(numbers) <= 2 for _, numbers in read)
    assert ("open", [2]) in read and ("decisions", [3]) in read
    key = lambda r: (r.turn_id, r.kind, r.answer, r.answer_version)
    got = spark.read.parquet(f"{folder}/answers/batch=*")
    assert sorted(map(key, got.collect())) == sorted(map(key, answers.collect()))
    opened = {(r.session_id, r.turn_id) for r in spark.read.parquet(f"{folder}/open/batch=4").collect()}
    assert opened == {("d", 1)}
    held = lambda df: {r.session_id: (r.answer_version, r.n_turns) for r in df.collect()}
    assert held(spark.read.parquet(f"{folder}/all_states/batch=4")) == held(states)


def test_sessions_that_say_nothing_are_forgotten(spark, index, tmp_path):
    folder, live_s = str(tmp_path / "out"), Settings().session_ttl_s
    decided = ct.live_turns(spark.createDataFrame([*said("a", 0, BOTH), *said("b", 0, "what is the parking like near the river")[:-1]], MESSAGES))
    later = ct.live_turns(spark.createDataFrame(said("c", 0, "catering for events"), MESSAGES))
    live.take(decided, 0, index, folder, now=1000.0, every=1)
    live.take(decided.limit(0), 1, index, folder, now=1001.0, every=1)
    assert {r.session_id for r in spark.read.parquet(f"{folder}/all_states/batch=1").collect()} == {"a"}
    live.take(later, 2, index, folder, now=1001.0 + live_s, every=1)
    assert {r.session_id for r in spark.read.parquet(f"{folder}/all_states/batch=2").collect()} == {"c"}
    assert {r.session_id for r in spark.read.parquet(f"{folder}/open/batch=1").collect()} == {"b"} and spark.read.parquet(f"{folder}/open/batch=2").isEmpty()


def test_a_controller_that_waits_answers_later(spark):
    said_ = corpus.spoken(spark.createDataFrame([("s", 1, BOTH), ("s", 2, "what is the parking like near the river bank")], "session_id string, turn_id long, utterance string"))
    got = {r["mode"]: r for r in evaluation.controller_arms(said_).collect()}
    assert got["rule"].median_ttft_ms < got["always_wait"].median_ttft_ms == 120.0 and got["rule"].median_early_start_ms > got["always_wait"].median_early_start_ms == 0.0


def test_a_report_is_whole_or_an_error(spark, tmp_path):
    rows = spark.range(3).withColumnRenamed("id", "n")
    assert evaluation.report({"ids": rows}, str(tmp_path)).count("\n| ") == 4 and spark.read.json(str(tmp_path / "ids")).count() == 3
    with pytest.raises(ValueError, match="more than"):
        evaluation.report({"ids": rows}, most=2)


def test_an_index_counts_when_it_is_complete(spark, index, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        corpus.read_index(spark, path)
    corpus.write_index(index, path)
    (tmp_path / "index" / "v99999999999999999999").mkdir()  # begun and not finished
    assert corpus.read_index(spark, path).chunks.count() == index.chunks.count()
    corpus.write_index(index, path)
    assert len([p for p in (tmp_path / "index").iterdir() if (p / "_COMPLETE").exists()]) == 1


def test_documents_of_hits(spark, index):
    hits = spark.createDataFrame([("t", "Hall#c1"), ("t", "Hall#c2"), ("t", "Food#c1"), ("u", "Hall#c1")], "turn_id string, chunk_id string")
    assert {r.turn_id: r.n_documents for r in evaluation.distinct_documents(hits, index.chunks).collect()} == {"t": 2, "u": 1}
