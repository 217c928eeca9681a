"""The driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAME = [
    "token_counts", "bm25_topk", "weighted_rrf", "dense_knn_topk", "hashed_cosine", "entity_names", "session_gap_turns", "cost_by_turn_class", "entity_extract", "clause_split", "near_dup_greedy",
    "fused_evidence", "hybrid_search_md5", "ablation_arms", "turn_utterances", "controller_steps", "shortened", "capacity_extract", "doc_paragraph_chunks", "buffer_prefixes",
]


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score"]


@pytest.mark.parametrize("name", SAME)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "events", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SF, table)}.parquet'")
    rows = entry.queries()[name](spark, SF)
    order = sorted(rows.columns)
    got = sorted(map(repr, (tuple(r) for r in rows.select(*order).collect())))
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(order)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want
