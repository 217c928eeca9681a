"""Token blocks and vector codes against brute force and round trips."""

import functools
import hashlib
import math
import random
import struct
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespan.llm import queries, token_blocks, vector_codes
from tests.llm.test_ops import DOC, odd

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def folder():
    return tempfile.mkdtemp(prefix="tokens-") + "/t"


# --- blocks


def slow_decode(raw):
    """A segment read bit by bit, as the format says."""
    magic, block, n, total = struct.unpack_from("<8sIIQ", raw)
    assert magic == b"PFORIDS1"
    at = 24
    least = struct.unpack_from(f"<{n}I", raw, at)
    width = struct.unpack_from(f"<{n}B", raw, at + 4 * n)
    many = struct.unpack_from(f"<{n}H", raw, at + 5 * n)
    starts = struct.unpack_from(f"<{n}Q", raw, at + 7 * n)
    at += 15 * n
    out = []
    for i in range(n):
        data = raw[at + starts[i] :]
        bits = int.from_bytes(data[: -(-block * width[i] // 8)], "little")
        values = [bits >> k * width[i] & (1 << width[i]) - 1 for k in range(block)]
        data = data[-(-block * width[i] // 8) :]
        for k, above in zip(struct.unpack_from(f"<{many[i]}H", data), struct.unpack_from(f"<{many[i]}I", data, 2 * many[i]), strict=True):
            values[k] += above << width[i]
        out += [v + least[i] for v in values]
    return out[:total]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 49407), st.integers(0, 2**32 - 1)), max_size=400), st.sampled_from([1, 3, 32, 128]), st.sampled_from([0, 50, 90, 100]), st.data())
def test_blocks_round_trip(ids, block, percentile, data):
    raw = token_blocks.encode(np.array(ids, np.uint32), block, percentile)
    assert slow_decode(raw) == ids
    assert token_blocks.decode(raw).tolist() == ids
    a, b = data.draw(st.integers(0, 420)), data.draw(st.integers(0, 420))
    assert token_blocks.decode(raw, a, b).tolist() == ids[a:b]


def test_outliers_do_not_widen_a_block():
    ids = np.arange(128, dtype=np.uint32) % 8
    small = len(token_blocks.encode(ids))
    ids[[5, 77]] = 49_000
    assert len(token_blocks.encode(ids)) == small + 2 * 6
    with pytest.raises(ValueError, match="not a segment"):
        token_blocks.decode(b"\0" * 40)


# --- ids


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = ["", " ", "a", "It's THE end…", "é ́x\ńy", "a b c\u0085d\x0be", "ΑΣ ΑΣ. ǅ İstanbul", "日本語 テキスト。", "x" * 5000 + " " + "ab12" * 900, "<|endoftext|> a<|startoftext|>b", "\0\x1f ﻿", "a\r\n\tb  c", "👩‍👩 🏳️‍🌈", "don't DON'T 'll''s"]


def test_words_asked_once_give_the_ids_of_whole_texts():
    rnd = random.Random(1)
    letters = "aAeEsS'̧́ \t\n\x0b\x0c\r\x1c\x85\xa0 .-1é한ßΣ<|>"
    texts = ODD_TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]
    by_words, whole = token_blocks.Encoder(PATH, True), token_blocks.Encoder(PATH, False)
    for a in range(0, len(texts), 90):  # remembered words are used from the second batch on
        some = texts[a : a + 90]
        for to_ids in (by_words, whole):
            ids, counts = to_ids(pa.array(some), 2)
            ends = np.cumsum(counts)
            assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [plain_ids(t) + [2] for t in some]
    ids, counts = by_words(pa.array([], pa.string()), 2)
    assert len(ids) == len(counts) == 0


def test_words_of_small_letters_go_to_the_model_alone(monkeypatch):
    rnd = random.Random(2)
    letters = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)])]
    words = list({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 90))) for _ in range(3000)} | set(letters))
    to_ids, asked = token_blocks.Encoder(PATH, True), []
    monkeypatch.setattr(token_blocks.Encoder, "_ids", lambda self, text: asked.append(text) or self.tokenizer.encode(text, add_special_tokens=False).ids)
    ids, counts = to_ids(pa.array(words), 2)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [plain_ids(w) + [2] for w in words]
    assert asked == []  # before, all of these words went through normalizer, splitter and marks
    to_ids(pa.array(["e\u0301 don't 12 \u017fa"]), 2)
    assert sorted("".join(asked).replace(token_blocks.MARK, " ").split()) == ["'t", "12", "e\u0301", "\u017fa"]


def brute_stream(rows):
    """(doc_id, start, n_tokens, crc, ids) of rows in order."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = plain_ids(text) + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("segment", [1, 50, token_blocks.SEGMENT])
def test_stream_equals_brute_force(spark, segment):
    rnd = random.Random(segment)
    rows = [(i, " ".join(rnd.choice(["Alpha", "beta,", "x1", "Γ", "'s"]) for _ in range(rnd.randrange(40)))) for i in range(120)]
    rnd.shuffle(rows)
    docs, to = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), folder()
    token_blocks.write(docs, to, PATH, 2, by_words=True, segment=segment)
    stored, want = token_blocks.segments(spark, to), brute_stream(rows)
    assert sorted(map(tuple, token_blocks.documents(stored).collect())) == want
    if segment == 1:
        assert stored.count() == len(rows)
    flat = [x for *_, ids in want for x in ids]
    for a, b in ((0, 5), (311, 502), (len(flat) - 3, len(flat) + 9), (9, 9)):
        assert [(r["position"], r["id"]) for r in sorted(token_blocks.ids_between(stored, a, b).collect())] == list(enumerate(flat))[a:b]


def test_odd_documents(spark):
    to = folder()
    token_blocks.write(odd(spark), to, PATH, 2)
    got = token_blocks.documents(token_blocks.segments(spark, to), with_ids=False).orderBy("start").collect()
    want = brute_stream([(r["doc_id"], r["text"]) for r in odd(spark).collect()])
    assert [tuple(r) for r in got] == [r[:4] for r in want]
    assert got[0]["n_tokens"] == 1 and got[-1]["doc_id"] is None


def test_no_documents(spark):
    to = folder()
    token_blocks.write(spark.createDataFrame([], DOC), to, PATH, 2)
    assert token_blocks.documents(token_blocks.segments(spark, to)).collect() == []


def test_many_rows_of_one_doc_id(spark):
    """They are dealt to several tasks, and still in one order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs, to = spark.range(0, 900, 1, 6).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 9).alias("text")), folder()
    token_blocks.write(docs, to, PATH, 2, by_words=True, segment=300)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = token_blocks.segments(spark, to)
    assert stored.select("part").distinct().count() > 1
    got = token_blocks.documents(stored).orderBy("start").collect()
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()
    runs = [a["ids"] for a, b in zip(got, [*got[1:], None], strict=True) if b is None or a["ids"] != b["ids"]]
    assert len(runs) == 9 and len(got) == 900


def test_op11_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op11_token_blocks(spark, d).orderBy("doc_id").collect()
    want = brute_stream([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    assert [tuple(r) for r in got] == [r[:4] for r in want]


# --- vectors


def brute_codes(rows, rounds=6):
    """(vec_id, code, error, label_error, digest) by loops over Python's whole numbers."""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    x = [[math.floor(4096 * c) for c in v] for _, v, _ in kept]
    size = len(x[0]) // 8
    first = {}
    for i, v in sorted(((i, v) for (i, _, _), v in zip(kept, x, strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[v[p * size : p * size + size] for v in list(first.values())[:16]] for p in range(8)]
    near = lambda p, part: min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            parts = [v[p * size : p * size + size] for v in x]
            found = [near(p, part)[1] for part in parts]
            for e in set(found):
                own = [part for part, f in zip(parts, found, strict=True) if f == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [[near(p, v[p * size : p * size + size]) for p in range(8)] for v in x]
    errors = [sum(d for d, _ in c) for c in coded]
    total = {}
    for (_, _, lab), err in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + err
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in c), err, total[lab], digest) for (i, _, lab), c, err in zip(kept, coded, errors, strict=True)), key=str)


VEC = "vec_id long, embedding array<float>, label int, code string, error int"


def coded(spark, rows):
    vectors = spark.createDataFrame([(*r, "other", 3) for r in rows], VEC).repartition(3)
    return sorted(map(tuple, vector_codes.compress(vectors).collect()), key=str)


@pytest.mark.parametrize("width", [8, 24])
def test_codes_equal_brute_force(spark, width):
    rnd = random.Random(width)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, rnd.uniform(-2, 2)]) for _ in range(width)], rnd.choice([None, 1, 2])) for i in range(90)]
    rnd.shuffle(rows)
    assert coded(spark, rows) == brute_codes([(i, np.float32(v).tolist(), lab) for i, v, lab in rows])


def test_odd_vectors(spark):
    one = [0.25 * k for k in range(8)]
    odd_rows = [(1, None, 1), (2, [], 1), (3, [None] + one[1:], 1), (4, [float("nan")] + one[1:], 1), (5, [float("-inf")] + one[1:], None)]
    rows = [*odd_rows, (9, one, None), (9, one, None), (9, one[::-1], 2), (None, [-x for x in one], None), (None, one, 2), (6, one, 1)]
    got = coded(spark, rows)
    assert got == brute_codes(rows) and len(got) == 6
    assert coded(spark, odd_rows) == []
    assert coded(spark, []) == []
    equal = [(i, one, i % 2) for i in range(40)]
    assert {r[1] for r in coded(spark, equal)} == {"00" * 8}


def test_repeated_ids_before_the_sixteenth(spark):
    rnd = random.Random(5)
    rows = [(i // 20, [rnd.uniform(-1, 1) for _ in range(8)], None) for i in range(400)]
    assert coded(spark, rows) == brute_codes([(i, np.float32(v).tolist(), lab) for i, v, lab in rows])


@pytest.mark.parametrize(("rows", "says"), [([[0.5] * 8, [0.5] * 16], "components"), ([[1.0] * 9], "equal parts"), ([[1e9] * 8], "too large")])
def test_vectors_that_cannot_be_coded(spark, rows, says):
    with pytest.raises(Exception, match=says):
        coded(spark, [(i, v, None) for i, v in enumerate(rows)])


def test_decoded_vectors_have_the_stated_error(spark):
    rnd = random.Random(3)
    vectors = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(16)], 1, "", 0) for i in range(60)], VEC)
    rows = vector_codes.usable(vectors)
    books = vector_codes.train(rows)
    got = vector_codes.decode(vector_codes.encode(rows, books), books).join(rows.select("vec_id", F.col("vector").alias("real")), "vec_id").collect()
    for r in got:
        assert r["error"] == sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(r["real"], r["vector"], strict=True))


def test_sums_of_many_labels_take_a_shuffle(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(50)]
    want = coded(spark, rows)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert coded(spark, rows) == want
