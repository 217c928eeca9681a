"""Registered queries of the engine's operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.functions import evidence as ev
from lorespan.functions import requests as rq
from lorespan.functions import text as tx
from lorespan.functions import vectors as vc
from lorespan.lineage import cut, spread
from lorespan.operators import chunking, evaluation, patching, subqueries
from lorespan.operators import retrieval as rt
from lorespan.plans import turns as tn
from lorespan.settings import DEFAULT
from lorespan.sources import corpus
from lorespan.streaming import controller, sessions

#: Turns in the words that the classifiers know, beside those of the table.
SAID = (
    "please make it shorter", "Translate that to Spanish", "as a table please", "explain it like I am five", "say that again", "shorten it and add the parking info",
    "actually make it 50 people", "and with parking", "what about the cancellation policy", "find a venue for 30 people", "venue capacity in Pune", "cancel the booking",
    "Find a venue for 30 people in Pune and retrieve the cancellation policy", "hey so can you tell me about catering; parking and also the wifi",
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their own."""
    return spread(_t(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("section"), "text", F.col("source").alias("citation"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


SPARSE, MD5 = replace(DEFAULT, use_dense=False), replace(DEFAULT, digest="md5")


def _sparse_index(spark: SparkSession, sf_dir: str) -> rt.Index:
    return rt.build(_documents(spark, sf_dir), SPARSE)


def _micros(column: str):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the conversations and the fixed turns."""
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SAID)], "id long, text string")
    return spread(_t(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "text").unionByName(own)


_SAID_SQL = "SELECT conv_id * 1000000 + turn AS id, text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(SAID)) + ") AS v(id, text)"
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_SINGULAR = "CASE WHEN length({0}) > 5 AND {0} LIKE '%ies' THEN {0}[1:-4] || 'y' WHEN length({0}) > 4 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' AND {0} NOT LIKE '%us' THEN {0}[1:-2] ELSE {0} END"
_POSTINGS = f"""
tok AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest({_TOKENS.format("concat_ws(' ', doc_id, source, text)")}) AS w FROM documents),
post AS (SELECT chunk_id, {_SINGULAR.format("w")} AS term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT chunk_id, count(*) AS doc_len FROM tok GROUP BY chunk_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS avg_len),
terms AS (SELECT term, count(*) AS df, greatest(ln(1.0 + (any_value(n_chunks) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM post, stats GROUP BY term)
"""
_BM25 = f"""{_POSTINGS},
qt AS (SELECT item_id AS query_id, {_SINGULAR.format("w")} AS term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS w FROM benchmark) GROUP BY ALL),
score AS (
  SELECT query_id, post.chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN len ON len.chunk_id = post.chunk_id, stats GROUP BY ALL),
top AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM score QUALIFY rank <= 10)
"""


def token_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def plural_tokens(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("w"))
    return rows.groupBy(tx.singular(F.col("w")).alias("term")).agg(F.count("*").alias("n"))


def corpus_stats(spark, sf_dir):
    return rt.corpus_stats(_documents(spark, sf_dir)).select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


def term_stats(spark, sf_dir):
    chunks = _documents(spark, sf_dir)
    return rt.term_stats(rt.postings(chunks), rt.corpus_stats(chunks)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25_top(spark, sf_dir, top=10, index=None):
    return rt.sparse_top(_queries(spark, sf_dir), index or _sparse_index(spark, sf_dir), top).drop("source")


def bm25_topk(spark, sf_dir):
    return _bm25_top(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _overlap_top(spark, sf_dir, index):
    """A second list: documents by the number of different query terms they have."""
    return rt.shared_top(_queries(spark, sf_dir), index, 10)


def _lists(spark, sf_dir, second):
    index = _sparse_index(spark, sf_dir)
    a = _bm25_top(spark, sf_dir, index=index).select("query_id", F.lit(0).alias("list_no"), "rank", "chunk_id", F.lit(1.0).alias("weight"))
    b = _overlap_top(spark, sf_dir, index).select("query_id", F.lit(1).alias("list_no"), "rank", "chunk_id", F.lit(second).alias("weight"))
    return a.unionByName(b)


def rrf_fusion(spark, sf_dir):
    return rt.rrf(_lists(spark, sf_dir, 1.0)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def weighted_rrf(spark, sf_dir):
    return rt.rrf(_lists(spark, sf_dir, 0.5)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def _rrf_sql(second):
    return f"""WITH {_BM25},
ov AS (SELECT query_id, chunk_id, count(*) AS s FROM (SELECT DISTINCT query_id, term FROM qt) JOIN post USING (term) GROUP BY ALL),
ot AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM ov QUALIFY rank <= 10)
SELECT query_id, chunk_id, round(sum(w / (60.0 + rank)), 9) AS score
FROM (SELECT query_id, chunk_id, rank, 1.0 AS w FROM top UNION ALL SELECT query_id, chunk_id, rank, {second} FROM ot) GROUP BY ALL"""


def rerank_lexical(spark, sf_dir):
    q = _queries(spark, sf_dir).select("query_id", tx.term_set(F.col("text")).alias("q"))
    c = _documents(spark, sf_dir).select("chunk_id", tx.term_set(F.concat_ws(" ", "section", "text")).alias("c"))
    rows = _bm25_top(spark, sf_dir, 8).select("query_id", "chunk_id").join(q, "query_id").join(c, "chunk_id")
    scored = rows.select("query_id", "chunk_id", F.round(rt.rerank_score(F.col("q"), F.col("c"), F.lit(0.0)), 9).alias("score"))
    return rt.ranked(scored, ["query_id"], "chunk_id", 5)


def hybrid_search(spark, sf_dir):
    return rt.search(_queries(spark, sf_dir), rt.build(_documents(spark, sf_dir))).withColumn("score", F.round("score", 6))


def hybrid_search_md5(spark, sf_dir):
    """hybrid_search with the hash that SQL has, too."""
    found = rt.search(_queries(spark, sf_dir), rt.build(_documents(spark, sf_dir), MD5), MD5)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def ablation_arms(spark, sf_dir):
    found = evaluation.ablations(_queries(spark, sf_dir), rt.build(_documents(spark, sf_dir), MD5), MD5)
    return found.groupBy("arm", "query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"), F.min_by("chunk_id", "rank").alias("first"))


def fused_evidence(spark, sf_dir):
    hits = _bm25_top(spark, sf_dir, 5).select((F.col("query_id") % 10).alias("turn_id"), F.col("query_id").alias("query_no"), "rank", "chunk_id", "score")
    return rt.fuse_results(hits, _documents(spark, sf_dir)).select("turn_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def doc_paragraph_chunks(spark, sf_dir):
    return chunking.chunks(spread(_t(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("raw")), delimiter="\n")


def term_overlap(spark, sf_dir):
    q = _queries(spark, sf_dir).select("query_id", F.col("text").alias("claim"))
    rows = _bm25_top(spark, sf_dir, 5).join(q, "query_id").join(_documents(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return rows.select("query_id", "chunk_id", F.round(ev.claim_overlap(F.col("claim"), F.col("text")), 6).alias("overlap"))


def support_score(spark, sf_dir):
    rows = term_overlap(spark, sf_dir)
    return rows.select("query_id", "chunk_id", F.round(ev.support(F.col("overlap"), F.lit(0.0)), 5).alias("support"), ev.entails(F.col("overlap"), F.lit(0.0)).alias("entailed"))


def hashed_vectors(spark, sf_dir):
    rows = _queries(spark, sf_dir).select("query_id", F.explode(vc.md5_vector(F.col("text"), DEFAULT.dim)).alias("i", "v"))
    return rows.where(F.abs("v") > 1e-9).select("query_id", "i", F.round("v", 6).alias("v"))


def hashed_cosine(spark, sf_dir):
    a = _queries(spark, sf_dir).select("query_id", vc.md5_vector(F.col("text"), DEFAULT.dim).alias("a"))
    b = a.select((F.col("query_id") - 1).alias("query_id"), F.col("a").alias("b"))
    return a.join(b, "query_id").select("query_id", F.round(vc.map_dot(F.col("a"), F.col("b")), 6).alias("cosine"))


_VECTORS = f"""
tk AS (SELECT item_id AS query_id, {_TOKENS.format("text")} AS t FROM benchmark),
w AS (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM tk),
f AS (
  SELECT query_id, 'w:' || t[i] AS f, 1.0::DOUBLE AS x FROM w
  UNION ALL SELECT query_id, 'c:' || substr(p, j, 4), 0.45 FROM (SELECT query_id, '^' || t[i] || '$' AS p, unnest(range(1, length(t[i]))) AS j FROM w WHERE length(t[i]) > 1)
  UNION ALL SELECT query_id, 'b:' || t[i] || '_' || t[i + 1], 0.8 FROM w WHERE i < len(t)),
s AS (SELECT query_id, CAST(('0x' || substr(md5(f), 1, 8))::BIGINT % 512 AS INTEGER) AS i, sum(CASE WHEN substr(md5(f), 9, 1) IN ('8','9','a','b','c','d','e','f') THEN x ELSE -x END) AS v FROM f GROUP BY ALL),
u AS (SELECT query_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS v FROM s)
"""


def dense_knn_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    blocks = cut(rt.pack(rt.gathered(rows, "vec_id"), "vec_id"))
    found = rt.nearest(rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), blocks, 10, "vec_id", seeded=True)
    return found.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def live_index_semijoin(spark, sf_dir):
    return rt.exists(_t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"), "quality"), _documents(spark, sf_dir))


def unlabelled_antijoin(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti")


def presentation_class(spark, sf_dir):
    rows = _said(spark, sf_dir).withColumn("p", rq.presentation(F.col("text"), F.lit(True)))
    return rows.select("id", F.col("p.suppressed").alias("suppressed"), F.col("p.transform").alias("transform"))


def request_flags(spark, sf_dir):
    t = F.col("text")
    return _said(spark, sf_dir).select("id", rq.is_correction(t).alias("correction"), rq.is_capacity(t).alias("capacity"), rq.is_cancellation(t).alias("cancellation"), rq.ends(t, F.lit(0.0)).alias("ended"))


def entity_names(spark, sf_dir):
    names = F.filter(rq.entities(F.col("text")), lambda e: e.startswith("ent:"))
    return spread(_t(spark, sf_dir, "documents")).select("doc_id", F.size(names).cast("long").alias("n_names"), F.array_join(names, " ").alias("names"))


def entity_extract(spark, sf_dir):
    return _said(spark, sf_dir).select("id", F.array_join(rq.entities(F.col("text")), "|").alias("entities"))


def clause_split(spark, sf_dir):
    return _said(spark, sf_dir).select("id", F.array_join(rq.clauses(F.col("text")), "|").alias("clauses"))


def near_dup_greedy(spark, sf_dir):
    rows = subqueries.decompose(_said(spark, sf_dir).withColumnRenamed("text", "utterance"), MD5)
    return rows.select("id", F.array_join("sub_queries", "|").alias("sub_queries"))


def capacity_extract(spark, sf_dir):
    rows = spread(_t(spark, sf_dir, "documents")).select("doc_id", F.concat("text", F.lit(" Lake Hall seats 40 people at most. ")).alias("text"))
    made = ev.capacity_claim(F.lit("a venue for 30 people"), F.array(F.struct(F.col("doc_id").alias("chunk_id"), "text")))
    return rows.select("doc_id", made["text"].alias("claim"))


def spoken_chunks(spark, sf_dir):
    rows = spread(_t(spark, sf_dir, "conversations")).select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_id"), F.col("text").alias("utterance"))
    return corpus.spoken(rows)


def buffer_prefixes(spark, sf_dir):
    return corpus.buffers(spoken_chunks(spark, sf_dir)).select("session_id", "turn_id", "seq", "buffer")


def controller_decisions(spark, sf_dir):
    return controller.decisions(spoken_chunks(spark, sf_dir))


def controller_steps(spark, sf_dir):
    """The decisions alone, to the end of each turn."""
    return controller.decisions(spoken_chunks(spark, sf_dir), stop_at_end=False).select("session_id", "turn_id", "seq", "decision", F.size("entities").cast("long").alias("n_entities"))


def speculated_turns(spark, sf_dir):
    """What is looked up while turns are being said, and how much of it the turns use."""
    index = _sparse_index(spark, sf_dir)
    decided = cut(controller.decisions(spoken_chunks(spark, sf_dir)))
    spoken = cut(tn.speculate(decided, index, SPARSE))
    said = controller.utterances(decided).select(F.concat_ws(":", "session_id", F.col("turn_id").cast("string")).alias("turn_id"), "utterance")
    asked = cut(subqueries.decompose(said, SPARSE).select("turn_id", "sub_queries"))
    hits, reused = tn.look_up_after(asked, spoken, index, SPARSE)
    before = spoken.groupBy("turn_id").agg(F.count("*").alias("n_before"), F.sum("calls").alias("calls_before"), F.round(F.min("at"), 3).alias("first_at"))
    found = hits.groupBy("turn_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return asked.join(before, "turn_id", "left").join(reused, "turn_id", "left").join(found, "turn_id", "left").select("turn_id", F.size("sub_queries").alias("n_sub_queries"), *(zero(c) for c in ("n_before", "calls_before", "n_reused", "n_chunks")), "first_at")


def turn_utterances(spark, sf_dir):
    rows = controller.utterances(controller.decisions(spoken_chunks(spark, sf_dir), stop_at_end=False))
    return controller.latency(rows, F.col("ended_at") + 0.1)


def ordered_distinct_types(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return rows.select("user_id", F.array_join(F.array_distinct(F.transform("e", lambda x: x["event_type"])), ",").alias("types"))


def session_gap_turns(spark, sf_dir):
    rows = controller.silent_turns(_t(spark, sf_dir, "events"), "user_id", "ts", "600 seconds")
    return rows.select("user_id", "n_events", _micros("started").alias("started"), _micros("ended").alias("ended"))


def latency_median_by_type(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.lit("ours").alias("system"), F.col("value").alias("ttft_ms"), (F.col("value") * 2).alias("wall_ms"), (F.col("value") / 2).alias("early_start_ms"))
    return evaluation.latency_medians(rows)


def recall_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    gold, found = F.array(F.lit(1), F.lit(2)), F.array("quality", F.col("toxic") + 1)
    return evaluation.recall(rows.select(F.col("lang").alias("type"), gold.alias("gold"), found.alias("found")))


def cost_by_turn_class(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "fresh").when(F.col("turn") % 3 == 0, "refine").otherwise("naive")
    calls, tokens = F.when(F.col("role") == "assistant", 4).otherwise(2), tx.estimated_tokens(F.col("text"))
    rows = _t(spark, sf_dir, "conversations").select(kind.alias("class"), calls.alias("calls"), (calls / 2).alias("sub_queries"), tokens.alias("tokens"))
    return evaluation.cost_by_class(rows.withColumn("usd", evaluation.cost(F.col("calls"), F.col("tokens"), F.lit(0)))).withColumn("mean_usd", F.round("mean_usd", 7))


def token_estimates(spark, sf_dir):
    return _said(spark, sf_dir).select("id", tx.estimated_tokens(F.col("text")).alias("tokens"), F.size(tx.display_tokens(F.col("text"))).cast("long").alias("pieces"))


def text_numbers(spark, sf_dir):
    found = F.filter(tx.whole_numbers(F.col("text")), lambda n: n.isNotNull())
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.coalesce(F.array_max(found), F.lit(-1)).alias("largest"))


def first_seen_roles(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


def live_sessions(spark, sf_dir):
    at = _micros("ts") / 1000000
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), at.alias("written_at"), F.when(F.col("event_type") != "purchase", F.col("event_id")).alias("state"))
    end = _t(spark, sf_dir, "events").agg(F.max(at).alias("now"))
    return sessions.live(rows.join(F.broadcast(end)), F.col("now"), 86400 * 5).select("session_id", "state")


def shortened(spark, sf_dir):
    return _said(spark, sf_dir).select("id", patching.restyled(F.col("text"), F.lit("presentation_shorten")).alias("short"), patching.restyled(F.col("text"), F.lit("presentation_restructure")).alias("bullet"))


def answered_turns(spark, sf_dir):
    # every look-up reads the chunks several times, so they are made once
    index = rt.build(cut(chunking.chunks(spread(_t(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("raw")), delimiter="\n")))
    own = spark.createDataFrame([(f"t{i}", f"s{i}", 0, t) for i, t in enumerate(SAID)], "turn_id string, session_id string, turn long, utterance string")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    session = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws(":", session, place.cast("string")).alias("turn_id"), session.alias("session_id"), place.cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("utterance"))
    return tn.answer_sessions(rows.unionByName(own), index).drop("claims")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        token_counts, plural_tokens, corpus_stats, term_stats, bm25_topk, rrf_fusion, weighted_rrf, rerank_lexical, hybrid_search, hybrid_search_md5, ablation_arms, fused_evidence, doc_paragraph_chunks,
        term_overlap, support_score, hashed_vectors, hashed_cosine, dense_knn_topk, live_index_semijoin, unlabelled_antijoin, presentation_class, request_flags, entity_names, entity_extract,
        clause_split, near_dup_greedy, capacity_extract, spoken_chunks, buffer_prefixes, controller_decisions, controller_steps, speculated_turns, turn_utterances, ordered_distinct_types, session_gap_turns,
        latency_median_by_type, recall_rollup, cost_by_turn_class, token_estimates, text_numbers, first_seen_roles, live_sessions, shortened, answered_turns,
    )
}


def _flag(pattern: str, column: str = "t") -> str:
    return f"regexp_matches({column}, '(?i){pattern}')"


def _strip(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^\\s+|\\s+$', '', 'g')"


_OVERLAP = f"""
qs AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS q FROM benchmark),
ds AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, list_distinct({_TOKENS.format("text")}) AS c FROM documents),
o AS (SELECT query_id, chunk_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, c)) / len(q) END, 6) AS overlap FROM top JOIN qs USING (query_id) JOIN ds USING (chunk_id) WHERE rank <= 5)
"""
_KINDS = " ".join(f"WHEN {_flag(p)} THEN '{k}'" for k, p in rq.PRESENTATION)
_SPOKEN = """
w AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM conversations),
g AS (SELECT session_id, turn_id, ws, CAST(ceil(len(ws) / 3.0) AS INTEGER) AS n, unnest(range(0, CAST(ceil(len(ws) / 3.0) AS INTEGER))) AS seq FROM w),
c AS (SELECT session_id, turn_id, CAST(seq AS INTEGER) AS seq, n, array_to_string(ws[seq * 3 + 1:seq * 3 + 3], ' ') AS text FROM g)
"""
SQL: dict[str, str] = {
    "token_counts": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)",
    "plural_tokens": f"SELECT {_SINGULAR.format('w')} AS term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS w FROM documents) GROUP BY 1",
    "corpus_stats": f"WITH {_POSTINGS} SELECT n_chunks, round(avg_len, 6) AS avg_len FROM stats",
    "term_stats": f"WITH {_POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top",
    "rrf_fusion": _rrf_sql(1.0),
    "weighted_rrf": _rrf_sql(0.5),
    "rerank_lexical": f"""WITH {_BM25},
qs AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS q FROM benchmark),
ds AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, list_distinct({_TOKENS.format("concat_ws(' ', source, text)")}) AS c FROM documents),
r AS (SELECT query_id, chunk_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE 0.6 * (len(list_intersect(q, c)) / len(q)) END, 9) AS score FROM top JOIN qs USING (query_id) JOIN ds USING (chunk_id) WHERE rank <= 8)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 5""",
    "term_overlap": f"WITH {_BM25}, {_OVERLAP} SELECT * FROM o",
    "support_score": f"WITH {_BM25}, {_OVERLAP} SELECT query_id, chunk_id, CASE WHEN overlap >= 0.6 THEN round(0.7 * overlap, 5) END AS support, overlap >= 0.6 AS entailed FROM o",
    "hashed_vectors": f"WITH {_VECTORS} SELECT query_id, i, round(v, 6) AS v FROM u WHERE abs(v) > 1e-9",
    "hashed_cosine": f"WITH {_VECTORS} SELECT a.query_id, round(coalesce(sum(a.v * b.v), 0.0), 6) AS cosine FROM u a LEFT JOIN u b ON b.query_id = a.query_id + 1 AND b.i = a.i WHERE a.query_id + 1 IN (SELECT item_id FROM benchmark) GROUP BY a.query_id",
    "dense_knn_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.e, u.e) / (q.n * u.n) AS s FROM u q, u WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, round(s, 5) AS score FROM s QUALIFY rank <= 10""",
    "live_index_semijoin": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "unlabelled_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "presentation_class": f"""
WITH s AS (SELECT id, {_strip("text")} AS t FROM ({_SAID_SQL})),
k AS (SELECT id, CASE WHEN t = '' OR {_flag(rq.NEW_INFORMATION)} THEN '' {_KINDS} ELSE '' END AS transform FROM s)
SELECT id, transform <> '' AS suppressed, transform FROM k""",
    "request_flags": f"""
SELECT id, {_flag(rq.CORRECTION)} AS correction,
  contains(lower(t), 'venue') AND ({" OR ".join(f"contains(lower(t), '{w}')" for w in rq.CAPACITY_WORDS)}) AS capacity,
  contains(lower(t), 'cancel') AS cancellation, regexp_matches(t, '[.?!]$') AS ended
FROM (SELECT id, {_strip("text")} AS t FROM ({_SAID_SQL}))""",
    "entity_names": f"""
WITH n AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'),
    lambda w: regexp_full_match(w, '[A-Z][a-zA-Z][a-zA-Z]+') AND NOT list_contains([{", ".join(f"'{w}'" for w in rq.NO_NAMES)}], w)), lambda w: 'ent:' || lower(w)))) AS names FROM documents)
SELECT doc_id, CAST(len(names) AS BIGINT) AS n_names, array_to_string(names, ' ') AS names FROM n""",
    "spoken_chunks": f"WITH {_SPOKEN} SELECT session_id, turn_id, seq, round(seq * 0.3::DOUBLE, 3) AS t, text, seq = n - 1 AS is_final, CASE WHEN seq = n - 1 THEN 1.2 ELSE 0.0 END::DOUBLE AS silence_s, 'chunk' AS kind FROM c",
    "buffer_prefixes": f"WITH {_SPOKEN} SELECT session_id, turn_id, seq, string_agg(text, ' ') OVER (PARTITION BY session_id, turn_id ORDER BY seq) AS buffer FROM c",
    "ordered_distinct_types": "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) GROUP BY user_id",
    "session_gap_turns": """
WITH l AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT user_id, t, count(*) FILTER (gap IS NULL OR gap > 600000000) OVER (PARTITION BY user_id ORDER BY t) AS no FROM l)
SELECT user_id, count(*) AS n_events, min(t) AS started, max(t) AS ended FROM s GROUP BY user_id, no""",
    "latency_median_by_type": "SELECT event_type AS type, 'ours' AS system, count(*) AS n, round(median(value), 2) AS median_ttft_ms, round(median(value * 2), 2) AS median_wall_ms, round(median(value / 2), 2) AS median_early_start_ms FROM events GROUP BY GROUPING SETS ((event_type), ())",
    "recall_rollup": "SELECT lang AS type, count(*) AS n, round(avg((CASE WHEN quality = 1 OR toxic = 0 THEN 0.5 ELSE 0 END) + (CASE WHEN toxic = 1 THEN 0.5 ELSE 0 END)), 4) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "cost_by_turn_class": """
WITH m AS (
  SELECT CASE WHEN role = 'assistant' THEN 'fresh' WHEN turn % 3 = 0 THEN 'refine' ELSE 'naive' END AS class, CASE WHEN role = 'assistant' THEN 4 ELSE 2 END AS calls,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM conversations),
a AS (SELECT class, count(*) AS n, round(avg(calls), 4) AS mean_calls, round(avg(calls / 2), 4) AS mean_sub_queries, round(avg(tokens), 4) AS mean_tokens,
    round(round(avg(round(tokens / 1000 * 0.003 + calls * 0.00002, 8)), 8), 7) AS mean_usd FROM m GROUP BY class)
SELECT *, round((1 - (SELECT mean_calls FROM a WHERE class = 'refine') / (SELECT mean_calls FROM a WHERE class = 'fresh')) * 100, 2) AS reduction_pct FROM a""",
    "token_estimates": f"SELECT id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens, CAST(len(regexp_extract_all(text, '\\S+\\s*')) AS BIGINT) AS pieces FROM ({_SAID_SQL})",
    "text_numbers": "SELECT doc_id, CAST(len(x) AS BIGINT) AS n, coalesce(list_max(x), -1) AS largest FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\d+'), lambda d: TRY_CAST(d AS BIGINT)), lambda d: d IS NOT NULL) AS x FROM documents)",
    "first_seen_roles": "SELECT conv_id, string_agg(role, ',' ORDER BY seen, role) AS roles FROM (SELECT conv_id, role, min(turn) AS seen FROM conversations GROUP BY ALL) GROUP BY conv_id",
    "live_sessions": """
WITH w AS (SELECT user_id AS session_id, epoch_us(ts) / 1000000 AS seen, CASE WHEN event_type <> 'purchase' THEN event_id END AS state FROM events),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seen DESC, state DESC NULLS LAST) = 1)
SELECT session_id, state FROM l WHERE state IS NOT NULL AND seen + 432000 > (SELECT max(seen) FROM w)""",
}



def _squeeze(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"


def _clean(column: str) -> str:
    leads = "|".join(x.replace("'", "''") for x in tx.LEADS)
    return f"trim(trim(regexp_replace({_squeeze(column)}, '(?i)^(?:(?:{leads})\\s+)+', '')), ' ,.;')"


#: Characters that words are made of, as the patterns of requests have it.
_W = r"\p{L}\p{N}\p{M}_"


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _entities(text: str) -> str:
    """The sorted entities of a text."""
    words = f"regexp_split_to_array({text}, '[^{_W}]+')"
    low = f"regexp_split_to_array(lower({text}), '[^{_W}]+')"
    numbers = [f"regexp_extract_all({text}, '(?:^|[^{_W}])(\\d+(?:[.,]\\d+)?)([{_W}]*)', {i})" for i in (1, 2)]
    slots = [w for w in rq.SLOTS if w != "%"]
    return f"""list_sort(list_distinct(list_concat(list_concat(
      list_transform(regexp_extract_all({text}, '[$₹€£]\\s?\\d[\\d,]*(?:\\.\\d+)?'), lambda m: 'money:' || regexp_replace(m, '\\s+', '', 'g')),
      list_transform(list_filter(list_zip({numbers[0]}, {numbers[1]}), lambda z: z[2] = ''), lambda z: 'num:' || z[1])), list_concat(
      list_transform(list_filter({words}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z][a-zA-Z]+') AND NOT list_contains({_listed(rq.NO_NAMES)}, w)), lambda w: 'ent:' || lower(w)),
      list_transform(list_filter({_listed(slots)}, lambda w: list_contains({low}, w)), lambda w: 'slot:' || w)))))"""


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
_PARTS = f"""list_filter(list_transform(regexp_split_to_array(whole, '(?i){rq.CLAUSE}'), lambda p: trim(p, ' ,.;')), lambda p: p <> '')"""
#: Vectors of texts, as in hybrid search.
_DENSE = f"""
src AS (SELECT CAST(doc_id AS VARCHAR) AS id, false AS asked, source || '. ' || text AS x FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR), true, text FROM benchmark),
vt AS (SELECT id, asked, {_TOKENS.format("x")} AS t FROM src),
vw AS (SELECT id, asked, t, unnest(range(1, len(t) + 1)) AS i FROM vt),
vf AS (
  SELECT id, asked, 'w:' || t[i] AS f, 1.0::DOUBLE AS x FROM vw
  UNION ALL SELECT id, asked, 'c:' || substr(p, j, 4), 0.45 FROM (SELECT id, asked, '^' || t[i] || '$' AS p, unnest(range(1, length(t[i]))) AS j FROM vw WHERE length(t[i]) > 1)
  UNION ALL SELECT id, asked, 'b:' || t[i] || '_' || t[i + 1], 0.8 FROM vw WHERE i < len(t)),
vs AS (SELECT id, asked, CAST(('0x' || substr(md5(f), 1, 8))::BIGINT % 512 AS INTEGER) AS i, sum(CASE WHEN substr(md5(f), 9, 1) IN ('8','9','a','b','c','d','e','f') THEN x ELSE -x END) AS v FROM vf GROUP BY ALL),
vu AS (SELECT id, asked, i, v / sqrt(sum(v * v) OVER (PARTITION BY id, asked)) AS v FROM vs),
cosines AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.v * c.v) AS cosine FROM vu q JOIN vu c ON q.i = c.i WHERE q.asked AND NOT c.asked GROUP BY ALL),
qs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct({_TOKENS.format("text")}) AS q FROM benchmark WHERE trim(text) <> ''),
ds AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, list_distinct({_TOKENS.format("concat_ws(' ', source, text)")}) AS c FROM documents),
sparse AS (SELECT CAST(query_id AS VARCHAR) AS query_id, chunk_id, rank FROM top),
dense AS (
  SELECT query_id, chunk_id, rank FROM (
    SELECT query_id, chunk_id, round(coalesce(cosine, 0), 8) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(cosine, 0), 8) DESC, chunk_id) AS rank
    FROM (SELECT query_id, chunk_id FROM qs, ds) LEFT JOIN cosines USING (query_id, chunk_id)) WHERE rank <= 10 AND s > 0),
arms AS (SELECT * FROM (VALUES ('hybrid', true, true, true), ('dense_only', false, true, true), ('sparse_only', true, false, true), ('no_reranker', true, true, false)) AS a(arm, use_sparse, use_dense, use_reranker)),
lists AS (SELECT arm, use_reranker, query_id, chunk_id, rank FROM arms, sparse WHERE use_sparse UNION ALL SELECT arm, use_reranker, query_id, chunk_id, rank FROM arms, dense WHERE use_dense),
fused AS (SELECT arm, use_reranker, query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s FROM lists GROUP BY ALL),
cand AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY s DESC, chunk_id) AS place FROM fused QUALIFY place <= 8),
judged AS (
  SELECT arm, query_id, chunk_id, CASE WHEN NOT use_reranker THEN 1.0::DOUBLE / place WHEN len(q) = 0 THEN 0 ELSE 0.6 * len(list_intersect(q, c)) / len(q) + 0.4 * greatest(coalesce(cosine, 0), 0) END AS score
  FROM cand JOIN qs USING (query_id) JOIN ds USING (chunk_id) LEFT JOIN cosines USING (query_id, chunk_id)),
final AS (SELECT arm, query_id, chunk_id, score, row_number() OVER (PARTITION BY arm, query_id ORDER BY round(score, 7) DESC, chunk_id) AS rank FROM judged QUALIFY rank <= 5)
"""
#: Buffers of turns, chunk by chunk, with what the rules look at.
_STEPS = f"""{_SPOKEN},
bufs AS (SELECT session_id, turn_id, seq, n, round(seq * 0.3::DOUBLE, 3) AS t, text, string_agg(text, ' ') OVER (PARTITION BY session_id, turn_id ORDER BY seq) AS buffer FROM c),
own AS (SELECT *, {_entities("text")} AS found FROM bufs),
ents AS (
  SELECT session_id, turn_id, seq, count(e) AS n_entities FROM (
    SELECT o.session_id, o.turn_id, o.seq, f.e FROM own o LEFT JOIN (
      SELECT session_id, turn_id, e, min(seq) AS first FROM (SELECT session_id, turn_id, seq, unnest(found) AS e FROM own) GROUP BY ALL) f
      ON f.session_id = o.session_id AND f.turn_id = o.turn_id AND f.first <= o.seq) GROUP BY ALL),
ruled AS (
  SELECT b.*, n_entities, b.seq = b.n - 1 OR regexp_matches(buffer, '[.?!]$') AS ended,
    length(buffer) >= 28 AND (n_entities >= 1 OR len(list_filter(string_split(buffer, ' '), lambda w: length(w) > 3)) >= 5) AS ready
  FROM bufs b JOIN ents USING (session_id, turn_id, seq))
"""
_CLAUSES = f"""
WITH s AS (SELECT id, {_clean("text")} AS whole FROM ({_SAID_SQL})),
p AS (SELECT id, whole, {_PARTS} AS parts FROM s),
j AS (
  SELECT id, whole, CASE WHEN len(parts) = 0 THEN [whole] ELSE string_split(list_reduce(parts, lambda acc, x:
    acc || CASE WHEN len(list_filter(string_split(x, ' '), lambda w: w <> '')) < 3 THEN ' ' ELSE chr(1) END || x), chr(1)) END AS joined FROM p),
k AS (SELECT id, whole, list_transform(joined[1:4], lambda x: coalesce(nullif({_clean("x")}, ''), x)) AS kept FROM j),
c AS (
  SELECT id, whole, kept, list_filter({_listed(rq.PLACES)}, lambda x: contains(lower(kept[1]), x))[1] AS place,
    list_filter(list_transform(string_split(whole, ' '), lambda w: regexp_replace(w, '[^A-Za-z0-9%.-]', '', 'g')), lambda w: list_contains({_listed(rq.CITIES)}, lower(w))) AS cities FROM k),
x AS (SELECT *, array_to_string(list_concat(list_filter([place], lambda q: q IS NOT NULL), cities), ' ') AS suffix FROM c),
r AS (
  SELECT id, CASE WHEN whole = '' THEN [] WHEN len(kept) <= 1 THEN kept ELSE list_transform(kept, lambda part, i: CASE WHEN i = 1 OR suffix = '' THEN part ELSE
    CASE WHEN coalesce(list_contains(regexp_extract_all(lower(part), '[{_W}]+'), place), false)
      AND (len(cities) = 0 OR len(list_filter(cities, lambda y: list_contains(regexp_extract_all(lower(part), '[{_W}]+'), regexp_replace(lower(y), '[^a-z0-9]', '', 'g')))) > 0)
      THEN part ELSE part || ' ' || suffix END END) END AS raw, whole, suffix FROM x)
SELECT id, array_to_string(CASE WHEN len(raw) <= 1 THEN raw ELSE list_transform(raw, lambda m, i: CASE WHEN i = 1 OR suffix = '' THEN m ELSE coalesce(nullif({_clean("m")}, ''), m) END) END, '|') AS clauses FROM r"""
SQL |= {
    "entity_extract": f"SELECT id, array_to_string({_entities('text')}, '|') AS entities FROM ({_SAID_SQL})",
    "clause_split": _CLAUSES,
    "near_dup_greedy": f"""
WITH s AS (SELECT id, text, string_split(clauses, '|') AS q FROM ({_CLAUSES}) JOIN ({_SAID_SQL}) USING (id)),
e AS (SELECT id, unnest(range(1, len(q) + 1)) AS k, unnest(q) AS x FROM s),
vt AS (SELECT id, k, {_TOKENS.format("x")} AS t FROM e),
vw AS (SELECT id, k, t, unnest(range(1, len(t) + 1)) AS i FROM vt),
vf AS (
  SELECT id, k, 'w:' || t[i] AS f, 1.0::DOUBLE AS x FROM vw
  UNION ALL SELECT id, k, 'c:' || substr(p, j, 4), 0.45 FROM (SELECT id, k, '^' || t[i] || '$' AS p, unnest(range(1, length(t[i]))) AS j FROM vw WHERE length(t[i]) > 1)
  UNION ALL SELECT id, k, 'b:' || t[i] || '_' || t[i + 1], 0.8 FROM vw WHERE i < len(t)),
vs AS (SELECT id, k, CAST(('0x' || substr(md5(f), 1, 8))::BIGINT % 512 AS INTEGER) AS i, sum(CASE WHEN substr(md5(f), 9, 1) IN ('8','9','a','b','c','d','e','f') THEN x ELSE -x END) AS v FROM vf GROUP BY ALL),
vu AS (SELECT id, k, i, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id, k)), 0) AS v FROM vs),
far AS (SELECT a.id, a.k AS a, b.k AS b, sum(a.v * b.v) >= 0.85 AS near FROM vu a JOIN vu b ON a.id = b.id AND a.i = b.i AND a.k < b.k GROUP BY ALL),
n AS (SELECT id, coalesce(bool_or(near) FILTER (a = 1 AND b = 2), false) AS n12, coalesce(bool_or(near) FILTER (a = 1 AND b = 3), false) AS n13, coalesce(bool_or(near) FILTER (a = 2 AND b = 3), false) AS n23,
  coalesce(bool_or(near) FILTER (a = 1 AND b = 4), false) AS n14, coalesce(bool_or(near) FILTER (a = 2 AND b = 4), false) AS n24, coalesce(bool_or(near) FILTER (a = 3 AND b = 4), false) AS n34 FROM far GROUP BY id),
g AS (
  SELECT s.id, text, q, NOT coalesce(n12, false) AS k2, NOT (coalesce(n13, false) OR (NOT coalesce(n12, false) AND coalesce(n23, false))) AS k3, coalesce(n14, false) AS n14, coalesce(n24, false) AS n24, coalesce(n34, false) AS n34
  FROM s LEFT JOIN n ON n.id = s.id)
SELECT id, CASE WHEN len(list_filter(q, lambda x: x <> '')) = 0 THEN coalesce(nullif({_clean("text")}, ''), trim(text)) ELSE
  array_to_string(list_filter(q, lambda x, i: x <> '' AND CASE i WHEN 1 THEN true WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE NOT (n14 OR (k2 AND n24) OR (k3 AND n34)) END), '|') END AS sub_queries FROM g""",
    "fused_evidence": f"""WITH {_BM25},
h AS (SELECT query_id % 10 AS turn_id, query_id AS query_no, rank, chunk_id, round(score, 9) AS score FROM top WHERE rank <= 5),
f AS (SELECT turn_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s, max(score) AS best FROM h GROUP BY ALL),
t AS (SELECT f.*, text FROM f JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id QUALIFY row_number() OVER (PARTITION BY turn_id, text ORDER BY s DESC, chunk_id) = 1)
SELECT turn_id, chunk_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank, round(s + 0.001 * best, 6) AS score FROM t
QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY s DESC, chunk_id) <= 5""",
    "capacity_extract": r"""
WITH d AS (SELECT doc_id, text || ' Lake Hall seats 40 people at most. ' AS x FROM documents),
g AS (SELECT doc_id, %s FROM d),
z AS (SELECT doc_id, list_filter(list_transform(range(1, len(g1) + 1), lambda i: CASE WHEN coalesce(TRY_CAST(g2[i] AS BIGINT) >= 30, false)
  THEN trim(g1[i], ' ' || chr(9) || chr(10) || chr(13)) || ' seats ' || TRY_CAST(g2[i] AS BIGINT) || CASE WHEN g3[i] <> '' THEN ' people' ELSE '' END || g4[i] END), lambda y: y IS NOT NULL) AS found FROM g)
SELECT doc_id, array_to_string(list_filter(found, lambda y, i: list_position(list_transform(found, lambda w: lower(w)), lower(y)) = i), ' ') AS claim FROM z"""
    % ", ".join(f"regexp_extract_all(x, '{ev._SEATS.replace(chr(39), chr(39) * 2)}', {i}) AS g{i}" for i in (1, 2, 3, 4)),
    "doc_paragraph_chunks": r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS ps FROM documents),
r AS (
  SELECT doc_id, string_split(list_reduce(ps, lambda acc, x: acc || CASE WHEN
      len(regexp_extract_all(string_split(acc, chr(1))[-1], '\S+')) + len(regexp_extract_all(x, '\S+')) > 90 THEN chr(1) ELSE chr(10) || chr(10) END || x), chr(1)) AS packs
  FROM p WHERE len(ps) > 0),
t AS (SELECT doc_id, list_filter(list_transform(packs, lambda x: trim(regexp_replace(x, '(?m)^#{1,6}\s+(.*)$', '\1', 'g'))), lambda x: len(regexp_extract_all(x, '\S+')) >= 15) AS kept FROM r),
u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM t)
SELECT doc_id || '#c' || i AS chunk_id, doc_id, 'intro' AS section, trim(regexp_replace(kept[i], '\s+', ' ', 'g')) AS text, doc_id || ' intro' AS citation FROM u""",
    "shortened": f"""
WITH s AS (SELECT id, text, coalesce(({_SENTENCES})[1], text) AS first FROM ({_SAID_SQL})),
w AS (SELECT *, regexp_extract_all(first, '\\S+') AS ws FROM s)
SELECT id, CASE WHEN len(ws) > 28 THEN regexp_replace(array_to_string(ws[1:28], ' '), '[,;]+$', '') || '…' ELSE first END AS short,
  '• ' || trim(regexp_replace(text, '^[• ]+', ''), ' ' || chr(9) || chr(10) || chr(13)) AS bullet FROM w""",
    "hybrid_search_md5": f"WITH {_BM25}, {_DENSE} SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM final WHERE arm = 'hybrid'",
    "ablation_arms": f"WITH {_BM25}, {_DENSE} SELECT arm, CAST(query_id AS BIGINT) AS query_id, count(*) AS n, round(max(score), 4) AS best, min_by(chunk_id, rank) AS first FROM final GROUP BY arm, query_id",
    "turn_utterances": f"""WITH {_STEPS},
u AS (
  SELECT session_id, turn_id, max_by(buffer, seq) AS utterance, coalesce(min_by(t, seq) FILTER (ended), max(t)) AS ended_at,
    min_by(t, seq) FILTER (ready AND NOT ended) AS started_at, min_by(buffer, seq) FILTER (ready AND NOT ended) AS provisional FROM ruled GROUP BY ALL)
SELECT *, round((ended_at + 0.1 - ended_at) * 1000, 2) AS ttft_ms, coalesce(round(greatest(0.0, (ended_at - started_at) * 1000), 2), 0.0) AS early_start_ms FROM u""",
    "controller_steps": f"""WITH RECURSIVE {_STEPS},
walk AS (
  SELECT session_id, turn_id, -1 AS seq, '' AS decision, CAST(-1e9 AS DOUBLE) AS spoke_at, CAST(0 AS BIGINT) AS spoke_len, CAST(0 AS BIGINT) AS n_entities FROM ruled WHERE seq = 0
  UNION ALL
  SELECT session_id, turn_id, seq, decision, CASE WHEN decision = 'provisional_retrieve' THEN t ELSE spoke_at END, CASE WHEN decision = 'provisional_retrieve' THEN CAST(length(buffer) AS BIGINT) ELSE spoke_len END, n_entities FROM (
    SELECT r.session_id, r.turn_id, r.seq, r.t, r.buffer, r.n_entities, w.spoke_at, w.spoke_len, CASE WHEN ended THEN 'retrieve' WHEN ready AND r.t - w.spoke_at >= 0.3 AND (w.spoke_len = 0 OR
      len(list_intersect(regexp_extract_all(lower(substr(buffer, w.spoke_len + 1)), '[^\\s.,?!:;()\\[\\]{{}}]+'), {_listed(sorted(controller.JOINING))})) > 0
      AND len(list_intersect(regexp_extract_all(lower(substr(buffer, w.spoke_len + 1)), '[^\\s.,?!:;()\\[\\]{{}}]+'), {_listed(sorted(controller.ASKING))})) > 0) THEN 'provisional_retrieve' ELSE 'wait' END AS decision
    FROM walk w JOIN ruled r ON r.session_id = w.session_id AND r.turn_id = w.turn_id AND r.seq = w.seq + 1))
SELECT session_id, turn_id, CAST(seq AS INTEGER) AS seq, decision, n_entities FROM walk WHERE seq >= 0""",
}
