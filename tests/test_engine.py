"""Chunks, retrieval, turns, the controller and streams, end to end on a small corpus."""

import math
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lorespan.operators import chunking, evaluation, patching, subqueries, synthesis
from lorespan.operators import retrieval as rt
from lorespan.plans import registry
from lorespan.plans import turns as tn
from lorespan.settings import Settings
from lorespan.sources import corpus
from lorespan.streaming import controller as ct
from lorespan.streaming import sessions

HALLS = """# Halls of the city

## Seats

Orchid Hall seats 60 people in Pune near the river and has a wide stage. Lake House seats 20 people in Pune and is quiet in the evening.

## Empty

## Cancellation Pune

For a venue in Pune the rules are these. Cancellations made ten days ahead incur no charge for the organiser. Cancellations inside two days cost the full venue fee.
"""
FOOD = "# Food\n\nCatering for events is ordered a week ahead and the menu can be changed until three days before the event takes place.\n"
BOTH = "Find a venue for 30 people in Pune and retrieve the cancellation policy for the venue in Pune"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    (path / "Hall.md").write_text(HALLS)
    (path / "Food.md").write_text(FOOD)
    return str(path)


@pytest.fixture(scope="module")
def index(spark, folder, tmp_path_factory):
    chunks = chunking.chunks(corpus.read_markdown(spark, folder))
    return corpus.open_index(spark, str(tmp_path_factory.mktemp("index")), chunks)


def test_markdown_and_chunks(spark, folder, index):
    docs = {r.doc_id: r.title for r in corpus.read_markdown(spark, folder).collect()}
    assert docs == {"Hall": "Halls of the city", "Food": "Food"}
    got = {r.chunk_id: (r.section, r.citation) for r in index.chunks.collect()}
    # the blank section is no chunk but counts; the short intro is left out
    assert got == {"Hall#c1": ("§1 Seats", "Hall §1"), "Hall#c2": ("§3 Cancellation Pune", "Hall §3"), "Food#c1": ("intro", "Food intro")}
    with pytest.raises(FileNotFoundError):
        corpus.read_markdown(spark, folder + "/*.none")


def test_packing_closes_before_it_overflows(spark):
    df = spark.createDataFrame([("a b c\n\nd e\n\nf\n\n" + "g " * 9,)], "t string")
    assert df.select(chunking.packed(F.col("t"), 5).alias("p")).first().p == ["a b c\n\nd e", "f", ("g " * 9).strip()]


def brute_chunks(raw, words, least, delimiter):
    """(section, text) in order."""
    raw, out = re.sub(r"\r\n?", "\n", raw), []
    pieces = [p for i, p in enumerate(re.split(r"(?am)(?=^#{2,6}[^\S\n]+)", raw)) if p or i]
    before = 0 if pieces and re.match(r"(?a)#{2,6}[^\S\n]+", pieces[0]) is None else 1
    for i, piece in enumerate(pieces):
        head, label, body = re.match(r"(?a)#{2,6}[^\S\n]+(.*)\n?", piece), "intro", piece
        if head:
            label, body = f"§{i + before} {head[1].strip()}", piece[head.end() :]
        packs, n = [], 0
        for p in filter(None, (x.strip() for x in re.split(f"(?a){delimiter}", body))):
            if packs and n + len(p.split()) <= words:
                packs[-1], n = packs[-1] + "\n\n" + p, n + len(p.split())
            else:
                packs, n = [*packs, p], len(p.split())
        texts = [" ".join(re.sub(r"(?am)^#{1,6}\s+(.*)$", r"\1", p).split()) for p in packs]
        out += [(label, t) for t in texts if len(t.split()) >= least]
    return out


@pytest.mark.parametrize("delimiter", ["\n", chunking.BLANK_LINE])
def test_chunks_equal_brute_force_and_look_for_white_space_once(spark, delimiter):
    rnd = random.Random(5)
    parts = ["a", "b#", "cc", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\n## T x\n", "\n# h\n", "#", "\n#######  y", "\n###\u3000z \n", "\u00a0", "## "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(400)]
    made = chunking.chunks(spark.createDataFrame(rows, "doc_id int, raw string"), Settings(chunk_words=4, min_chunk_words=2), delimiter)
    got = {}
    for r in made.collect():
        got.setdefault(r.doc_id, []).append((int(r.chunk_id.split("#c")[1]), r.section, r.text))
    for i, raw in rows:
        assert [x[1:] for x in sorted(got.get(str(i), []))] == brute_chunks(raw, 4, 2, delimiter), raw
    # of a paragraph, and of a pack that has a heading; before, three times, and all packs were searched
    assert made._jdf.queryExecution().analyzed().toString().count("(?U)\\s+") == 2


def test_index_is_rebuilt_if_it_does_not_fit(spark, index, tmp_path):
    corpus.write_index(index, str(tmp_path))
    assert corpus.open_index(spark, str(tmp_path), index.chunks).chunks.count() == 3
    small = corpus.open_index(spark, str(tmp_path), index.chunks, Settings(dim=16))
    assert small.vectors.select(F.size("vec").alias("n")).first().n == 16


def test_bm25_equals_the_formula(spark):
    texts = {"d1": "venue venue fee", "d2": "fee table", "d3": "lake"}
    chunks = spark.createDataFrame([(i, "", "", t, "") for i, t in texts.items()], "chunk_id string, doc_id string, section string, text string, citation string")
    index = rt.build(chunks)
    posts, stats = rt.postings(chunks), rt.corpus_stats(chunks)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, posts.collect())) and index.stats.collect() == stats.collect()
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, rt.term_stats(posts, stats).collect()))
    queries = spark.createDataFrame([(1, "venues fee fee unknown"), (2, "")], "query_id int, text string")
    got = {r.chunk_id: r.score for r in rt.bm25(queries, index).collect()}
    idf = lambda df: max(math.log(1 + (3 - df + 0.5) / (df + 0.5)), 1e-6)
    part = lambda tf, n, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert got == pytest.approx({"d1": part(2, 3, 1) + 2 * part(1, 3, 2), "d2": 2 * part(1, 2, 2)})


def test_fusion(spark):
    rows = [(1, 0, r, c, 1.0) for r, c in enumerate(("a", "b", "a", "c"), 1)] + [(1, 1, r, c, 0.5) for r, c in enumerate(("c", "a"), 1)]
    df = spark.createDataFrame(rows, "query_id int, list_no int, rank int, chunk_id string, weight double")
    got = {r.chunk_id: r.score for r in rt.rrf(df).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 0.5 / 62, "b": 1 / 62, "c": 1 / 63 + 0.5 / 61})
    assert rt.rrf(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_sparse_top_equals_all_scores(spark, monkeypatch, block):
    """The best of each query over many small blocks, against bm25 over all pairs."""
    monkeypatch.setattr(rt, "BLOCK_ROWS", block)
    monkeypatch.setattr(rt, "BLOCK_QUERIES", block)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(("fee", "fees", "venue", "lake", "hall", "policy", "x1", "y2")) for _ in range(n))
    chunks = spark.createDataFrame([(f"c{i}", "d", "", text(rng.choice((0, 1, 4, 4, 9))), "") for i in range(60)], "chunk_id string, doc_id string, section string, text string, citation string").repartition(3)
    index = rt.build(chunks, Settings(use_dense=False))
    queries = spark.createDataFrame([(i, text(rng.choice((0, 1, 3)))) for i in range(12)] + [(50, "nothing known"), (51, None)], "query_id int, text string")
    want = {}
    for r in rt.bm25(queries, index).collect():
        want.setdefault(r.query_id, []).append((-round(r.score, 9), r.chunk_id))
    got = {}
    for r in rt.sparse_top(queries, index, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    assert got == {k: sorted(v)[:7] for k, v in want.items()}
    assert rt.sparse_top(queries.limit(0), index).count() == 0 and rt.sparse_top(queries, rt.build(chunks.limit(0))).count() == 0


def test_nearest_is_exact_with_ties(spark, monkeypatch):
    for block in (2, 4096):
        monkeypatch.setattr(rt, "BLOCK_ROWS", block)
        monkeypatch.setattr(rt, "BLOCK_QUERIES", block)
        vectors = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(99, [0.0, 0.0]), (98, None)]
        df = spark.createDataFrame(vectors, "vec_id long, vec array<double>").repartition(5)
        q = spark.createDataFrame([(i, v) for i, v in vectors[:5]], "query_id long, vec array<double>")
        got = {(r.query_id, r["rank"]): r.vec_id for r in rt.nearest(q, rt.pack(df, "vec_id"), 4, "vec_id").collect()}
        assert [got[0, r] for r in (1, 2, 3, 4)] == [0, 3, 6, 9] and [got[2, r] for r in (1, 2, 3, 4)] == [2, 5, 8, 11]
        assert rt.nearest(q.limit(0), rt.pack(df, "vec_id"), 4, "vec_id").count() == 0


def test_plans_do_not_grow_with_queries(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_QUERIES", 2)
    df = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    size = lambda n: len(rt.nearest(df.where(f"vec_id < {n}").withColumnRenamed("vec_id", "query_id"), rt.pack(df, "vec_id"), 3, "vec_id")._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(2) == size(40)


def test_search_and_its_switches(spark, index):
    q = spark.createDataFrame([(1, "venue cancellation in Pune"), (2, "  "), (3, "menu changed catering")], "query_id long, text string")
    best = lambda **s: {r.query_id: r.chunk_id for r in rt.search(q, index, Settings(**s)).where("rank = 1").collect()}
    assert best() == best(use_reranker=False) == best(use_dense=False) == {1: "Hall#c2", 3: "Food#c1"}
    assert set(best(use_sparse=False)) == {1, 3} == set(best(use_sparse=False, use_dense=False))
    arms = evaluation.ablations(q, index).select("arm").distinct().count()
    assert arms == 4


def test_equal_texts_count_once_as_evidence(spark, index):
    copy = index.chunks.where("chunk_id = 'Food#c1'").withColumn("chunk_id", F.lit("Food#c9"))
    hits = spark.createDataFrame([(1, 0, 1, "Food#c1", 0.5), (1, 0, 2, "Food#c9", 0.9), (1, 1, 1, "Hall#c1", 0.2), (1, 1, 2, "gone", 0.2)], "turn_id int, query_no int, rank int, chunk_id string, score double")
    got = rt.fuse_results(hits, index.chunks.unionByName(copy)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["Food#c1", "Hall#c1"] and got[0].score == pytest.approx(1 / 61 + 0.0005)


def test_turns_of_a_session(spark, index):
    first = spark.createDataFrame([("t1", "a", BOTH), ("t2", "b", "what about catering")], "turn_id string, session_id string, utterance string")
    none = spark.createDataFrame([], tn.STATE)
    answers = tn.answer_turns(first, none, index).cache()
    got = {r.turn_id: r for r in answers.collect()}
    a = got["t1"]
    assert a.kind == "fresh" and len(a.sub_queries) == 2 and a.uncertainty is None and a.calls == 4 and a.usd == pytest.approx(8e-5)
    assert [c.text for c in a.claims] == ["Orchid Hall seats 60 people in Pune near the river and has a wide stage.", "Cancellations made ten days ahead incur no charge for the organiser. Cancellations inside two days cost the full venue fee."]
    assert a.citations == ["Hall §1", "Hall §3"] and [c.claim_id for c in a.claims] == ["c1", "c2"]
    b = got["t2"]
    assert b.claims == [] and b.answer == "" and b.shown == tn.APOLOGY and b.uncertainties == ["catering"]
    general = tn.answer_turns(first.where("turn_id = 't2'"), none, index, Settings(draft_general=True)).first()
    assert general.claims and set(general.citations) <= {"Food intro", "Hall §1", "Hall §3"}
    states = tn.next_states(answers, none).cache()
    later = [("u1", "a", "actually make it 50 people"), ("u2", "b", "make it shorter")]
    got = {r.turn_id: r for r in tn.answer_turns(spark.createDataFrame(later, first.schema), states, index).collect()}
    assert got["u1"].kind == "refine" and got["u1"].answer_version == 2 and [c.status for c in got["u1"].claims] == ["modified_in_v2", "unchanged"]
    assert got["u2"].kind == "suppressed" and got["u2"].calls == 0 and got["u2"].retrieved == []
    unmet = tn.answer_turns(spark.createDataFrame([("u3", "a", "actually make it 500 people")], first.schema), states, index).first()
    assert [c.claim_id for c in unmet.claims] == ["c2"] and unmet.uncertainties == ["actually make it 500 people"]
    measured = evaluation.groundedness(answers.select("turn_id", "claims", F.col("uncertainties").alias("uncertainty")), index.chunks).first()
    assert (measured.n_claims, measured.n_supported, measured.n_fabricated, measured.n_uncertain_turns, measured.groundedness) == (2, 2, 0, 1, 1.0)
    naive = tn.naive_turns(first, index).collect()
    assert len(naive) == 2


def test_model_drafts_are_gated(spark, index):
    turns = spark.createDataFrame([("t", ["catering menu"], 0)], "turn_id string, sub_queries array<string>, answer_version int")
    hits = tn.look_up(turns, index)
    drafts = [("t", 0, "Catering for events is ordered a week ahead.", ["Food#c1", "made up"]), ("t", 0, "Catering for events is ordered one week ahead.", ["Food#c1"]), ("t", 0, "The moon is made of cheese.", ["Food#c1"]), ("t", 0, "The catering menu is free of charge on Mars and Venus forever.", [])]
    made = synthesis.synthesise(turns, hits, index.chunks, model_drafts=spark.createDataFrame(drafts, "turn_id string, sq_pos int, text string, ids array<string>")).first()
    assert [(c.text, c.chunk_ids, c.status) for c in made.claims] == [(drafts[0][2], ["Food#c1"], "unchanged")]
    assert drafts[3][2] in made.uncertainty and drafts[2][2] not in made.uncertainty


def test_reuse_and_order(spark):
    row = lambda *x: spark.createDataFrame(list(x), "turn_id int, pos int, text string, vec array<double>, n_chunks int")
    asked = row((1, 0, "Catering options here", [1.0, 0.0], 1), (1, 1, "parking", [0.0, 1.0], 1)).withColumnRenamed("pos", "sq_pos")
    before = row((1, 0, "catering options", [0.9, 0.1], 2), (1, 1, "catering options here", [0.0, 1.0], 2), (1, 2, "parking", [0.0, 1.0], 0)).withColumnRenamed("pos", "prov_pos")
    got = {r.sq_pos: (r.prov_pos, r.score) for r in subqueries.reuse(asked, before).collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0)}
    df = spark.createDataFrame([(["fee", "venue seats"], ["a"], [(["a"],), (["b", "a"],), (["b"],)])], "q array<string>, used array<string>, p array<struct<ids:array<string>>>")
    got = df.select(subqueries.retrieval_order(F.col("q")).alias("o"), subqueries.unseen(F.col("used"), F.col("p")).alias("u")).first()
    assert got.o == ["venue seats", "fee"] and [x.ids for x in got.u] == [["b", "a"]]


def test_restyling(spark):
    long = "word " * 30 + "end. Second sentence."
    df = spark.createDataFrame([("One. Two.",), (long,), ("• a",)], "t string")
    short = [r.x for r in df.select(patching.restyled(F.col("t"), F.lit("presentation_shorten")).alias("x")).collect()]
    assert short == ["One.", ("word " * 28).strip() + "…", "• a"]
    assert df.select(patching.restyled(F.col("t"), F.lit("presentation_restructure")).alias("x")).collect()[2].x == "• a"


def test_measures(spark):
    rows = spark.createDataFrame([("single", [1, 2], [2, 3]), ("multi", [1], [1]), ("multi", [], [])], "type string, gold array<int>, found array<int>")
    assert {r.type: (r.n, r.recall) for r in evaluation.recall(rows).collect()} == {None: (3, 0.5), "single": (1, 0.5), "multi": (2, 0.5)}
    cost = spark.createDataFrame([("fresh", 4, 2, 0, 8e-5), ("fresh", 3, 1, 0, 6e-5), ("refine", 2, 1, 0, 4e-5)], "class string, calls int, sub_queries int, tokens int, usd double")
    got = {r["class"]: (r.mean_calls, r.reduction_pct) for r in evaluation.cost_by_class(cost).collect()}
    assert got == {"fresh": (3.5, 42.86), "refine": (2.0, 42.86)}
    flags = spark.createDataFrame([(True, ["x"], 0), (True, [], 0), (False, [], 1)], "must_flag boolean, uncertainty array<string>, n_fabricated int")
    assert [r.passed for r in evaluation.gauntlet(flags).collect()] == [True, False, False]
    arm = lambda x: spark.createDataFrame([(1, x, 2, 0.1)], "turn_id int, ttft_ms double, calls int, usd double")
    assert evaluation.race(arm(5.0), arm(7.5)).first().ttft_ms_saved == 2.5
    assert "| fresh |" in evaluation.report({"cost": evaluation.cost_by_class(cost)})


def spoken(spark):
    rows = [("s", 1, BOTH), ("s", 2, "hello. and more words here"), ("z", 1, "what is the parking like near the river"), ("e", 1, "")]
    return corpus.spoken(spark.createDataFrame(rows, "session_id string, turn_id long, utterance string"))


def test_controller_rules():
    found = {"in Pune for the whole team": ["ent:pune"], "of 30": ["num:30"], "Find a venue": [], "x": [], "": [], "done.": []}
    say = lambda turn, text, t=9.0, silence=0.0, final=False, **s: ct.step(turn, text, found.get(text, []), t, silence, final, Settings(**s))
    turn, a = say(ct.Turn(), "Find a venue")
    assert a.decision == ct.WAIT and a.reason.startswith("buffer_too_short")
    turn, a = say(turn, "in Pune for the whole team")
    assert a.decision == ct.SPECULATE and turn.fired
    assert say(turn, "x", 9.1)[1].reason == "provisional_cooldown_active"
    assert say(turn, "of 30", 12.0)[1].reason.startswith("same_intent_growth")
    assert say(turn, "and what is the policy", 12.0)[1].decision == ct.SPECULATE
    assert say(turn, "done.")[1].decision == say(turn, "", silence=1.2)[1].decision == say(turn, "", final=True)[1].decision == ct.RETRIEVE
    assert say(ct.Turn(), "")[1].reason == "empty_buffer"
    assert say(ct.Turn(), "a long enough utterance to speculate", always_wait=True)[1].reason == "controller_mode=always_wait"
    assert ct.Turn.load(turn.dump()) == turn


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["and what policy", "Pune", "30 people", "the river", "now.", "", "also tell me about catering"]), max_size=8))
def test_controller_never_speculates_after_the_end(parts):
    turn, t = ct.Turn(), 0.0
    for p in parts:
        before = turn
        turn, a = ct.step(turn, p, [f"ent:{p.lower()}"] if p == "Pune" else [], t, 0.0, False)
        assert a.decision != ct.SPECULATE or not turn.buffer.endswith(".")
        assert turn.buffer == " ".join(x for x in (before.buffer, p) if x) and a.entities == (["ent:pune"] if "Pune" in turn.buffer else [])
        t += 0.3


def test_batch_equals_stream(spark, tmp_path):
    rows = spoken(spark).where("turn_id = 1").cache()
    folder = str(tmp_path / "in")
    for seq in range(rows.agg(F.max("seq")).first()[0] + 1):
        rows.where(F.col("seq") == seq).coalesce(1).write.mode("append").json(folder)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = ct.decision_stream(corpus.transcript_stream(spark, folder), expire=False)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
    batch = ct.decisions(rows, stop_at_end=False)
    key = lambda df: sorted(tuple(r) for r in df.select("session_id", "turn_id", "seq", "decision", "buffer").collect())
    assert key(spark.read.parquet(out)) == key(batch) == key(ct.decisions(rows.repartition(3), stop_at_end=False))


def test_turns_from_decisions(spark):
    decided = ct.decisions(spoken(spark))
    got = {(r.session_id, r.turn_id): r for r in ct.latency(ct.utterances(decided), F.col("ended_at") + 0.05).collect()}
    assert got["s", 1].utterance == BOTH and got["s", 1].ttft_ms == 50.0 and got["s", 1].early_start_ms > 0
    # a closing mark in the middle ends a batch turn there, unless told otherwise
    late = spark.createDataFrame([("s", 1, 0, 0.0, "one two.", False, 0.0, "chunk"), ("s", 1, 1, 0.3, "three", True, 1.2, "chunk"), ("s", 1, 1, 0.3, "again", True, 1.2, "chunk")], corpus.TRANSCRIPT)
    assert ct.utterances(ct.decisions(late)).first().utterance == "one two."
    rows = ct.decisions(late, stop_at_end=False).collect()
    assert sorted(r.decision for r in rows) == ["late", "retrieve", "retrieve"]
    heard = spark.createDataFrame([("s", 1, 0, 0.0, "one two", False, 0.0, "chunk"), ("s", 1, 1, 0.3, "ten", True, 1.2, "replace")], corpus.TRANSCRIPT)
    assert ct.utterances(ct.decisions(heard)).first().utterance == "ten"


def test_sessions(spark, tmp_path):
    rows = [("a", 0.0, "x"), ("a", 10.0, "y"), ("b", 0.0, "x"), ("c", 10.0, "x"), ("c", 11.0, None)]
    df = spark.createDataFrame(rows, "session_id string, written_at double, state string")
    assert [tuple(r)[:3] for r in sessions.live(df, F.lit(20.0), 15).collect()] == [("a", 10.0, "y")]
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = sessions.session_stream(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), expire=False)
    seen = []
    corpus.fan_out(stream, [lambda b, n: 1 / 0, lambda b, n: seen.extend(b.collect())], str(tmp_path / "mark")).awaitTermination(120)
    assert sorted((r.session_id, r.version) for r in seen) == [("a", 1), ("a", 2), ("b", 1), ("c", 0), ("c", 1)]


def test_events(spark, tmp_path, tmp_path_factory):
    rows = spark.createDataFrame([("s", "r", 1.23456, "q")], "session_id string, run_id string, t double, query string")
    events = corpus.event_rows(rows, "retrieval_started", F.col("t"), "query")
    corpus.write_events(events, str(tmp_path))
    numbered = str(tmp_path_factory.mktemp("numbered"))
    for _ in range(2):  # a batch that runs again leaves each event once
        corpus.write_events(events, numbered, 3)
    corpus.write_events(events.limit(1), numbered, 4)
    found = spark.read.json(numbered).groupBy("batch").count()
    assert sorted(map(tuple, found.collect())) == [(3, events.count()), (4, 1)]
    got = spark.read.json(str(tmp_path))
    assert corpus.events_of(got, "retrieval_started").first().timestamp_s == 1.2346 and corpus.events_of(got, "x").count() == 0
    (tmp_path / "q.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert corpus.read_json_lines(spark, str(tmp_path / "q.jsonl"), "id string").count() == 2
    assert corpus.read_json_lines(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0


def test_buffer_prefixes_has_all_buffers_of_a_turn(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 3, 18, 19, 100)]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in registry.buffer_prefixes(spark, str(tmp_path)).collect())
    want = [("1", i, k, " ".join(t.split()[: 3 * k + 3])) for i, t in enumerate(texts) for k in range(-(-len(t.split()) // 3))]
    assert got == want


def test_entity_names_has_all_names_of_a_document(spark, tmp_path):
    names = [f"{a}{b}x" for a in "ABCDEFGHIJ" for b in "abcde"]
    texts = [" ".join(names[:n] + names[: n // 2]) for n in (0, 1, 20, 21, 50)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_names, r.names) for r in registry.entity_names(spark, str(tmp_path)).collect()}
    assert got == {i: (len(set(t.split())), " ".join(f"ent:{w.lower()}" for w in sorted(set(t.split())))) for i, t in enumerate(texts)}


def test_answered_turns_follow_each_other_in_a_session(spark, tmp_path):
    texts = [x for x in HALLS.split("\n") if len(x) > 40]
    spark.createDataFrame([(i, t, "Hall") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    said = [(1, 2, "make it shorter"), (1, 0, BOTH), (1, 1, "actually make it 50 people"), (2, 0, "make it shorter")]
    spark.createDataFrame([(c, n, "user", t) for c, n, t in said], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn_id: r for r in registry.answered_turns(spark, str(tmp_path)).collect()}
    assert len(got) == len(said) + len(registry.SAID) and {got[f"t{i}"].utterance for i in range(len(registry.SAID))} == set(registry.SAID)
    assert [got[f"1:{i}"].kind for i in range(3)] == ["fresh", "refine", "suppressed"] and [got[f"1:{i}"].answer_version for i in range(2)] == [1, 2]
    assert got["1:1"].answer and got["1:2"].calls == 0 and got["2:0"].kind == "fresh"
