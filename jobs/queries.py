"""The jobs as registered queries: each runs its function twice into one new folder and returns what stands there, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import corpus_refresh, turn_evidence
from jobs.common import stored
from lorespan.lineage import shared_folder
from lorespan.plans import registry


def job1_corpus_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        corpus_refresh.refresh(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint", delimiter="\n")
    return corpus_refresh.current(spark, f"{folder}/out")


JOB1_SQL = f"SELECT c.*, d.lang FROM ({registry.SQL['doc_paragraph_chunks']}) AS c JOIN documents AS d ON CAST(d.doc_id AS VARCHAR) = c.doc_id"


def job2_turn_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        turn_evidence.evidence(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", folder, digest="md5")
    return stored(spark, folder, turn_evidence.EVIDENCE)


_TURNS = """SELECT conv_id * 1000000 + turn AS id, x.t AS text FROM (
  SELECT conv_id, turn, min(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn) WHERE x.r = 'user'"""
_BM25 = registry._BM25.replace("SELECT item_id AS query_id, ", "SELECT query_id, ").replace("item_id", "query_id").replace("FROM benchmark", "FROM each_query")
JOB2_SQL = f"""
WITH said AS ({_TURNS}),
first AS (SELECT conv_id, min(turn) AS f FROM (
  SELECT conv_id, turn, min(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))) AS x FROM conversations GROUP BY conv_id, turn) WHERE x.r = 'assistant' GROUP BY conv_id),
form AS ({registry.SQL["presentation_class"].replace(registry._SAID_SQL, "FROM_SAID").replace("(FROM_SAID)", "said")}),
route AS (SELECT said.id, CASE WHEN form.suppressed AND coalesce(first.f < said.id % 1000000, false) THEN 'suppressed' ELSE 'searched' END AS route
  FROM said JOIN form ON form.id = said.id LEFT JOIN first ON first.conv_id = said.id // 1000000),
sub AS ({registry.SQL["near_dup_greedy"].replace(registry._SAID_SQL, "FROM_SAID").replace("(FROM_SAID)", "said")}),
parts AS (SELECT sub.id, CASE WHEN sub_queries = '' THEN [] ELSE string_split(sub_queries, '|') END AS q FROM sub JOIN route ON route.id = sub.id AND route = 'searched'),
each_query AS (SELECT id || '#' || i AS query_id, id, q[i] AS text FROM (SELECT id, q, unnest(range(1, len(q) + 1)) AS i FROM parts)),
{_BM25},
h AS (SELECT id, query_id, rank, chunk_id, round(score, 9) AS score FROM top JOIN each_query USING (query_id) WHERE rank <= 5),
f AS (SELECT id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s, max(score) AS best FROM h GROUP BY ALL),
t AS (SELECT f.*, text FROM f JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id QUALIFY row_number() OVER (PARTITION BY id, text ORDER BY s DESC, chunk_id) = 1),
u AS (SELECT id, chunk_id, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank, round(s + 0.001 * best, 6) AS score FROM t
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, chunk_id) <= 5)
SELECT route.id // 1000000 AS conv_id, route.id % 1000000 AS turn, CAST(coalesce(len(parts.q), 0) AS BIGINT) AS n_sub_queries, u.rank, u.chunk_id AS doc_id, u.score, route.route,
  CAST((route.id // 1000000) % 16 AS INTEGER) AS bucket
FROM route LEFT JOIN parts ON parts.id = route.id LEFT JOIN u ON u.id = route.id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_corpus_refresh, job2_turn_evidence)}
SQL = {"job1_corpus_refresh": JOB1_SQL, "job2_turn_evidence": JOB2_SQL}
