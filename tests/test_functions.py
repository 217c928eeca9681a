"""Column functions on tiny inputs with values worked out by hand."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lorespan.functions import evidence as ev
from lorespan.functions import requests as rq
from lorespan.functions import text as tx
from lorespan.functions import vectors as vc
from lorespan.lineage import spread
from lorespan.settings import Settings
from lorespan.streaming import controller as ct


def one(spark, make, *values):
    """The column made of string columns c0, c1 ... over one row."""
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "values", "want"),
    [
        (tx.tokens, ("Hé-llo W0rld 3.5",), ["h", "llo", "w0rld", "3", "5"]),
        (tx.tokens, (None,), []),
        (tx.index_tokens, ("policies ties venues glass campus gas bus",), ["policy", "ties", "venue", "glass", "campus", "gas", "bus"]),
        (tx.clean, ("  okay so  can you tell me   the fee, . ",), "the fee"),
        (tx.clean, (None,), ""),
        (tx.sentences, ("One. Two!  Three? four",), ["One.", "Two!", "Three?", "four"]),
        (tx.estimated_tokens, ("",), 0),
        (tx.estimated_tokens, ("abc",), 1),
        (tx.estimated_tokens, ("a" * 9,), 2),
        (tx.whole_numbers, ("30 of 1,200 for ₹5000",), [30, 1, 200, 5000]),
        (tx.display_tokens, ("a  b c",), ["a  ", "b ", "c"]),
        (tx.display_tokens, ("",), []),
        (tx.json_text, ('```json\n{"a": 1}\n```',), '{"a": 1}'),
        (tx.json_text, ('sure: {"a": [1]} done',), '{"a": [1]}'),
        (tx.json_text, ("no json",), None),
        (rq.entities, ("Book 30 people in Pune for ₹5,000 at 7 pm",), ["ent:pune", "money:₹5,000", "num:30", "num:5,000", "num:7", "slot:people", "slot:pm"]),
        (rq.is_capacity, ("A Venue with seats",), True),
        (rq.is_capacity, ("a hall with seats",), False),
        (rq.is_cancellation, ("Cancelled?",), True),
        (rq.known_places, ("is Orchid Hall free",), ["orchid hall"]),
        (rq.is_correction, ("Actually, make it 40",), True),
        (rq.clauses, ("Find a venue for 30 people in Pune and retrieve the cancellation policy",), ["Find a venue for 30 people in Pune", "retrieve the cancellation policy venue Pune"]),
        (rq.clauses, ("catering and wifi",), ["catering wifi"]),
        (rq.clauses, ("",), []),
        (ev.draft_key, ("B a. A",), "a a b"),
        (ev.required_people, ("for 30 People",), 30),
        (ev.required_people, ("for many",), None),
    ],
)
def test_text_functions(spark, make, values, want):
    assert one(spark, make, *values) == want


def test_sets(spark):
    assert one(spark, lambda a, b: ev.claim_overlap(a, b), "a b c d", "b d x") == 0.5
    assert one(spark, lambda a, b: ev.claim_overlap(a, b), "", "b") == 0.0
    assert one(spark, lambda a: tx.ordered_distinct(F.split(a, ",")), " b ,a,,b,a") == ["b", "a"]


@pytest.mark.parametrize(
    ("text", "state", "want"),
    [
        ("make it shorter", True, (True, "presentation_shorten")),
        ("in Spanish please", True, (True, "presentation_translate")),
        ("make it shorter", False, (False, "")),
        ("shorten it and what is the price", True, (False, "")),
        ("hello there", True, (False, "")),
        ("", True, (False, "")),
    ],
)
def test_presentation(spark, text, state, want):
    got = one(spark, lambda t: rq.presentation(t, F.lit(state)), text)
    assert (got.suppressed, got.transform) == want


def test_refinement(spark):
    ask = lambda text, topic: one(spark, lambda t: rq.refines(t, F.lit("catering menu"), F.array(F.lit("The catering menu is long.")), F.lit(topic)), text).refine
    assert ask("actually ten", 0.0) and ask("with catering", 0.5)
    assert not ask("with catering", 0.1) and not ask("catering please", 0.9) and not ask("with parking spaces", 0.9)


def test_repair_and_context(spark):
    said = "Find a venue for 30 people in Pune and retrieve the cancellation policy for the venue in Pune"
    glued = lambda a: rq.repaired(a, F.array(F.lit("find a venue for 30 people in Puneretrieve the cancellation policy")))
    assert one(spark, glued, said) == ["Find a venue for 30 people in Pune", "retrieve the cancellation policy for the venue in Pune"]
    assert one(spark, lambda a: rq.repaired(a, F.array(F.lit("x"))), "plain words") == ["x"]
    context = lambda a: rq.contextualised(a, F.array(F.lit("find a venue"), F.lit("the cancellation rules"), F.lit("parking for 30 people")))
    assert one(spark, context, said) == ["find a venue", "retrieve the cancellation policy for the venue in pune", "parking venue in pune"]


def test_claims_read_off_evidence(spark):
    evidence = F.array(*(F.struct(F.lit(i).alias("chunk_id"), F.lit(t).alias("text")) for i, t in (("a", "Lake Hall seats 20 people in all. Orchid Hall seats 60 people by the river."), ("b", "Nothing here."), ("c", "ORCHID HALL seats 60 people by the river."))))
    got = one(spark, lambda q: ev.capacity_claim(q, evidence), "a venue for 30 people")
    assert got.text == "Orchid Hall seats 60 people by the river." and got.ids == ["a", "c"]
    assert one(spark, lambda q: ev.capacity_claim(q, evidence), "a venue") is None
    rules = F.array(*(F.struct(F.lit(i).alias("chunk_id"), F.lit(t).alias("text")) for i, t in (("p", "In Pune it applies. Cancellations made early incur no charge"), ("m", "Mumbai: cancellations made late cost more."))))
    got = one(spark, lambda q: ev.cancellation_claim(q, rules), "cancel in Pune")
    assert got.text == "Cancellations made early incur no charge." and got.ids == ["p"]
    fits = lambda q, t, s: one(spark, lambda a, b: ev.relevant(a, b, F.lit(s)), q, t)
    assert fits("catering in Pune", "catering is in pune", 0.5) and not fits("catering in Pune", "catering in Mumbai", 0.9)
    assert not fits("parental leave policy", "the cancellation policy", 0.9) and fits("parental leave policy", "leave policy", 0.9)
    named = F.array(F.struct(F.lit("Doc_01").alias("doc_id"), F.lit("Lake Hall seats 40 people.").alias("text")), F.struct(F.lit("Doc_09").alias("doc_id"), F.lit("Far Hall seats 90 people.").alias("text")))
    assert one(spark, lambda q: ev.place_names(q, named, {"pune": ("doc_01",)}), "a venue in Pune for 30 people") == ["Lake Hall"]
    assert one(spark, lambda q: ev.place_names(q, named), "a venue in Pune for 30 people") == []
    assert one(spark, lambda q: ev.place_names(q, named), "venue capacity") == ["Lake Hall", "Far Hall"]


def test_vectors(spark):
    plain = vc.encode_text("venue capacity", 64)
    assert float((plain.astype(float) ** 2).sum()) == pytest.approx(1, abs=1e-6) and not vc.encode_text("", 64).any()
    assert one(spark, lambda a: vc.encoder(Settings(dim=64))(a), "venue capacity") == pytest.approx(plain.tolist())
    sparse = one(spark, lambda a: vc.md5_vector(a, 64), "venue capacity")
    assert sum(v * v for v in sparse.values()) == pytest.approx(1)
    assert one(spark, lambda a, b: vc.map_dot(vc.md5_vector(a, 64), vc.md5_vector(b, 64)), "venue", "venue") == pytest.approx(1)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, lambda a: vc.cosine(zero, F.array(F.lit(1.0), F.lit(0.0))), "") == 0.0
    assert one(spark, lambda a: vc.unit(F.array(F.lit(3.0), F.lit(4.0))), "") == pytest.approx([0.6, 0.8])


def test_settings():
    got = Settings.from_env(env={"LORESPAN_FINAL_TOP": "7", "LORESPAN_USE_DENSE": "no", "LORESPAN_REUSE": "much"})
    assert (got.final_top, got.use_dense, got.reuse, got.calls) == (7, False, 0.75, 1)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .₹,éPune30people%", max_size=30), min_size=1, max_size=4))
def test_entities_of_chunks_add_up_to_those_of_the_buffer(spark, texts):
    parts = [t.strip() for t in texts]
    whole = " ".join(t for t in parts if t)
    found = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate([*parts, whole])], "i int, t string").select("i", rq.entities(F.col("t")).alias("e")).orderBy("i").collect()]
    turn = ct.Turn()
    for t, e in zip(parts, found[:-1], strict=True):
        turn, a = ct.step(turn, t, e, 0.0, 0.0, False)
    assert turn.buffer == whole and list(turn.entities) == found[-1]
    again = vc.summed(vc.words_in(whole), 512)
    assert np.allclose(turn.vector, again)


def test_both_forms_of_md5_vectors_agree(spark):
    for text in ("a venue for 30 people, a venue", "x", "", "éa b", "word " * 40):
        sparse = one(spark, lambda a: vc.md5_vector(a, 64), text)
        dense = vc.encode_text(text, 64, "md5")
        assert dense.tolist() == pytest.approx([sparse.get(i, 0.0) for i in range(64)], abs=1e-6)


def brute_vector(text, dim):
    """The sum over features one by one, by BLAKE2b."""
    import hashlib

    words = re.findall("[a-z0-9]+", text.lower())
    named = [("w:" + w, 1.0) for w in words] + [("c:" + f"^{w}$"[i : i + 4], 0.45) for w in words for i in range(len(w) - 1)] + [(f"b:{a}_{b}", 0.8) for a, b in zip(words, words[1:])]
    out = np.zeros(dim)
    for name, weight in named:
        h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
        out[h % dim] += weight if h >> 63 else -weight
    return out / (np.linalg.norm(out) or 1.0)


def test_vectors_equal_brute_force(spark):
    texts = ["venue capacity in Pune", "a a a b", "", "30 people, 30 seats! " * 20, "éàü x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", vc.encoder(Settings())("t").alias("v")).collect()
    for r in rows:
        assert r.v == pytest.approx(brute_vector(texts[r.i], 512).tolist(), abs=1e-6)


def test_texts_of_a_batch_share_a_dictionary(monkeypatch):
    """Whatever is encoded with a text, in one piece or many, in either hash, and whatever the worker remembers."""
    rnd = random.Random(2)
    texts = [None, "", "İ ẞ K 30%", "x" * 3000] + [" ".join(rnd.choice(["a", "be", "venue", "30", "é", "venues,"]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    for digest in ("blake2b", "md5"):
        whole = vc.encode_texts(texts, 96, digest)
        for t, v in zip(texts, whole, strict=True):
            assert np.array_equal(vc.encode_text(t, 96, digest), v)
            assert np.array_equal(vc.scaled(vc.summed(vc.words_in(t), 96, digest)), v)
        monkeypatch.setattr(vc, "CHUNK", 50)
        monkeypatch.setattr(vc, "MEMORY", 3)
        assert np.array_equal(vc.encode_texts(texts, 96, digest), whole)
        monkeypatch.undo()
    assert vc.encode_texts([], 96).shape == (0, 96)


def test_a_pair_is_hashed_once_a_batch(monkeypatch):
    """However many texts of a batch have it, and whatever the batch is added up in."""
    asked, hashed = [], vc.hashed
    monkeypatch.setattr(vc, "hashed", lambda features, *a: asked.extend(list(map(str, features))) or hashed(features, *a))
    texts = ["pairs of words that all texts have"] * 9000
    made = vc.encode_texts(texts, 96)
    assert sum(f.startswith("b:") for f in asked) == 6  # before, for 4,096 texts at a time: 18
    assert (made == brute_vector(texts[0], 96).astype(np.float32)).all()


def test_vectors_as_bytes_are_the_same(spark):
    rows = spark.createDataFrame([(0, "venue in Pune"), (1, ""), (2, None), (3, "a b")], "i int, t string")
    kept = rows.select("i", vc.encoder(Settings())("t").alias("v"), F.when(F.col("i") != 3, vc.bytes_encoder(Settings())("t")).alias("b"))
    got = {r.i: r for r in kept.select("i", "v", vc.of_bytes()("b").alias("w"), "b").collect()}
    assert all(got[i].w == got[i].v and len(got[i].b) == 4 * 512 for i in range(3)) and got[3].w is None


def test_white_space_at_the_ends(spark):
    """As by (?U)\\s, without a search through what lies between."""
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = [c * 2 + "a " + c + " b" + c for c in every] + ["", " ", "\u3000\n", "x", None, " \U0001f600 "]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    words = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    assert df.where(~(tx.strip(F.col("t")).eqNullSafe(old) & tx.squeeze(F.col("t")).eqNullSafe(squeezed) & (tx.n_words(tx.squeeze(F.col("t"))) == words))).count() == 0
    assert "regexp" not in df.select(tx.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_out_only_if_cores_are_idle(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 9)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many
    assert sorted(r.id for r in spread(few).collect()) == list(range(100))
