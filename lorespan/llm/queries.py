"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm import blob_ledger, cotraining, decontam, html_density, jaccard, mixing, preference, surrogates, telephony, token_blocks, toxicity, vector_codes
from lorespan.llm.common import cut, shared_checkpoints, table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.format_pairs(preference.own_pairs(table(spark, sf_dir, "conversations")))
    ranges = lambda s: F.array_join(F.transform(f"{s}_masked", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(f"{s}_masked")
    return rows.select(F.col("pair_id").alias("conv_id"), F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", ranges("chosen"), "rejected", ranges("rejected"))


_OP1_SHOWN = "array_to_string(list_transform({0}, lambda u: '<|start|>' || u.r || chr(10) || u.t || '<|end|>' || chr(10)), '')"
_OP1_MASKED = """array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].r = 'assistant'),
    lambda i: (19 + {1}) || ':' || (19 + {1} + length({0}[i].t) + 8)), ',')""".replace("{1}", "coalesce(list_sum(list_transform({0}[1:i - 1], lambda u: 18 + length(u.r) + length(u.t))), 0)")
OP1_SQL = f"""
WITH one AS (
  SELECT conv_id, turn, min(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))) AS x
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
c AS (SELECT conv_id, list(x ORDER BY turn) AS ts FROM one GROUP BY conv_id),
a AS (SELECT conv_id, ts, list_filter(range(1, len(ts) + 1), lambda i: ts[i].r = 'assistant') AS pos FROM c),
p AS (
  SELECT conv_id, ts[1:pos[-1]] AS good, CASE WHEN len(pos) = 1 THEN ts[1:pos[-1] - 1] ELSE
    list_transform(range(1, pos[-1] + 1), lambda i: CASE WHEN list_contains(pos, i) AND i >= pos[len(pos) // 2 + 1]
      THEN struct_pack(r := ts[i].r, t := ts[pos[list_position(pos, i) - 1]].t) ELSE ts[i] END) END AS bad
  FROM a WHERE len(pos) > 0),
n AS (
  SELECT conv_id, good, bad, coalesce(list_min(list_filter(range(1, least(len(good), len(bad)) + 1), lambda i: good[i] <> bad[i])) - 1, least(len(good), len(bad))) AS n FROM p),
z AS (SELECT conv_id, n, good[1:n] AS shared, good[n + 1:] AS g, bad[n + 1:] AS b FROM n)
SELECT conv_id, CAST(n AS BIGINT) AS n_common, {_OP1_SHOWN.format("shared")} AS prompt,
  {_OP1_SHOWN.format("g")} AS chosen, {_OP1_MASKED.format("g")} AS chosen_masked,
  {_OP1_SHOWN.format("b")} AS rejected, {_OP1_MASKED.format("b")} AS rejected_masked
FROM z
"""


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    # as in use: a part of the versions came before and is in the ledger; now all paths are asked for
    came_before = F.xxhash64(F.coalesce("path", F.lit(0)), F.lit("arrival")) < 0
    ledger = cut(blob_ledger.scan(docs.where(came_before)))
    found = blob_ledger.scan_paths(docs, ledger=ledger)
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        F.col("path").alias("doc_id"),
        *counts,
        F.sha2(blob_ledger.listed(base), 256).alias("base_sha256"),
        blob_ledger.listed(F.col("spans")).alias("spans"),
    )


def _op2_kind(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return rf"""
  SELECT doc_id, {no} AS no, '{kind}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(m[i]) AS BIGINT) AS b FROM (
    SELECT doc_id, m, g, i, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
    FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d)))
  WHERE length(g[i]) >= {least}"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join((
    _op2_kind(0, "assign", blob_ledger._ASSIGN, 2, 12),
    _op2_kind(1, "access", "AKIA[A-Z0-9]+", 0, 18),
    _op2_kind(2, "hex", "[0-9a-f]{16,}", 0, 16),
))}),
f AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id
"""


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("lorespan.surrogates.key", "a key for checks, and no secret")
    rows = surrogates.pseudonymise(table(spark, sf_dir, "documents"), key)
    listed = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", F.size("entities").cast("long").alias("n_entities"), listed.alias("entities"), "text")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n AS m ON m.doc_id = a JOIN n AS o ON o.doc_id = b
  WHERE 100 * c >= 85 * (m.n + o.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS reached FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = cotraining.quality(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(cotraining.held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= cotraining.THRESHOLD).cast("int").alias("predicted"), "text_score", "meta_score")


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = telephony.archive(docs, f"{shared_checkpoints(spark)}/media-{uuid.uuid4().hex}")
    return stored.drop("fault")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
v AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
w AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON len(ws) >= n)),
m AS (SELECT w.doc_id, w.n, w.i, v.item FROM w JOIN v ON v.win = w.win AND v.n = w.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_checkpoints(spark)}/tokens-{uuid.uuid4().hex}"
    token_blocks.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2, by_words=True)
    return token_blocks.documents(token_blocks.segments(spark, folder), with_ids=False)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


_OP12_PARTS, _OP12_ENTRIES = vector_codes.PARTS, vector_codes.ENTRIES


def _op12_round(n: int) -> str:
    """One assignment of all parts to the codebooks b{n}, and the codebooks b{n + 1} after it."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT r, p, min([d, e]) AS m FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN b{n} AS b ON b.p = x.p) GROUP BY r, p),
c{n} AS (
  SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (
    SELECT x.p, a.m[2] AS e, unnest(x.v) AS y, unnest(range(len(x.v))) AS i FROM x JOIN a{n} AS a ON a.r = x.r AND a.p = x.p)
  GROUP BY p, e, i),
b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(any_value(c.v), any_value(b.v)) AS v FROM b{n} AS b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS v FROM c{n} GROUP BY p, e) AS c ON c.p = b.p AND c.e = b.e
  GROUP BY b.p, b.e),"""


OP12_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {_OP12_PARTS}) + 1:(p + 1) * (len(v) // {_OP12_PARTS})] AS v FROM k, (SELECT unnest(range({_OP12_PARTS})) AS p)),
f AS (SELECT min([r]) AS r, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM (
  SELECT vec_id, r, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS o FROM k) WHERE o = 1 GROUP BY vec_id),
b0 AS MATERIALIZED (SELECT x.p, CAST(f.e AS BIGINT) AS e, x.v FROM f JOIN x ON x.r = f.r[1] WHERE f.e < {_OP12_ENTRIES}),
{"".join(_op12_round(n) for n in range(vector_codes.ROUNDS + 1))}
o AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{vector_codes.ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(v, ',') AS t FROM b{vector_codes.ROUNDS}))
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM k JOIN o ON o.r = k.r CROSS JOIN h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference": op1_preference,
    "op2_blob_ledger": op2_blob_ledger,
    "op3_surrogates": op3_surrogates,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_cotraining": op5_cotraining,
    "op6_telephony_audio": op6_telephony_audio,
    "op7_decontamination": op7_decontamination,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_text_density": op9_text_density,
    "op10_mixing": op10_mixing,
    "op11_token_blocks": op11_token_blocks,
    "op12_vector_codes": op12_vector_codes,
}

SQL: dict[str, str] = {
    "op1_preference": OP1_SQL,
    "op2_blob_ledger": OP2_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op7_decontamination": OP7_SQL,
    "op12_vector_codes": OP12_SQL,
}
