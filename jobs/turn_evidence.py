"""Looks up evidence for every turn that users have said, for review and for tests of the retrieval.

    python -m jobs.turn_evidence --config jobs/turn_evidence.json --conversations IN --documents DOCS --output OUT

IN is Parquet with conv_id, turn, role, text; DOCS has doc_id, text, source. A turn that only asks for another
form of the last answer is routed past the search; others are split into sub-queries, all of them are
searched at once by BM25, and what they find is fused by rank. OUT has a row for each turn and rank, or one
without evidence for a turn that has none, partitioned by route and a bucket of conversations. A run replaces OUT
as a whole, so a run after a failed one, or a second one, leaves the same rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, stored
from lorespan.functions import requests as rq
from lorespan.lineage import cut
from lorespan.operators import retrieval, subqueries
from lorespan.settings import DEFAULT, Settings

PATHS = {"conversations": "Parquet with turns", "documents": "Parquet with documents", "output": "folder of the evidence"}
EVIDENCE = "conv_id long, turn long, n_sub_queries long, rank int, doc_id string, score double, route string, bucket int"


def user_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, text, answered (whether the assistant spoke before) of the users' turns; of several rows of one turn the smallest."""
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    one = rows.groupBy("conv_id", "turn").agg(F.min("x").alias("x")).select("conv_id", "turn", "x.role", "x.text")
    first = one.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("_first"))
    return one.where("role = 'user'").join(first, "conv_id", "left").select("conv_id", "turn", "text", F.coalesce(F.col("_first") < F.col("turn"), F.lit(False)).alias("answered"))


def look_up(turns: DataFrame, documents: DataFrame, settings: Settings, per_query: int, top: int) -> DataFrame:
    """conv_id, turn, n_sub_queries, rank, doc_id, score, route of turns (user_turns)."""
    routed = turns.withColumn("route", F.when(rq.presentation(F.col("text"), F.col("answered"))["suppressed"], "suppressed").otherwise("searched"))
    # a number of partitions that is asked for isn't lowered for rows that are few but take long
    cores = max(turns.sparkSession.sparkContext.defaultParallelism, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = routed.repartition(cores, "conv_id", "turn")
    asked = subqueries.decompose(routed.where("route = 'searched'").withColumnRenamed("text", "utterance"), settings)
    key = F.struct("conv_id", "turn")
    asked = cut(asked.select(F.to_json(key).alias("turn_id"), "conv_id", "turn", "sub_queries"))
    each = asked.select("turn_id", F.posexplode("sub_queries").alias("query_no", "text"))
    each = each.withColumn("query_id", F.concat_ws("#", F.col("query_no").cast("string"), "turn_id"))
    chunks = documents.where("doc_id IS NOT NULL").select(*(F.col("doc_id").cast("string").alias(c) for c in ("chunk_id", "doc_id")), F.col("source").alias("section"), "text", F.col("source").alias("citation"))
    found = retrieval.sparse_top(each.select("query_id", "text"), retrieval.build(chunks, replace(settings, use_dense=False)), per_query, settings)
    hits = found.join(each.select("query_id", "query_no", "turn_id"), "query_id")
    fused = retrieval.fuse_results(hits, chunks, top)
    left = routed.join(asked.select("conv_id", "turn", "turn_id", F.size("sub_queries").cast("long").alias("n_sub_queries")), ["conv_id", "turn"], "left")
    rows = left.join(fused.select("turn_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score")), "turn_id", "left")
    return rows.select("conv_id", "turn", F.coalesce("n_sub_queries", F.lit(0)).cast("long").alias("n_sub_queries"), "rank", "doc_id", "score", "route")


def evidence(spark: SparkSession, conversations: str, documents: str, output: str, *, per_query: int = 5, top: int = DEFAULT.final_top, buckets: int = 16, digest: str = "blake2b") -> dict:
    """Writes the evidence of all users' turns; returns how many rows it read and wrote.

    A turn without words has no sub-query and no evidence; rows without conv_id, turn or doc_id are left
    out, and counted.
    """
    said, docs = spark.read.parquet(conversations), spark.read.parquet(documents)
    rows = look_up(user_turns(said), docs, replace(DEFAULT, digest=digest), per_query, top)
    rows = rows.withColumn("bucket", F.pmod(F.col("conv_id"), F.lit(buckets)).cast("int"))
    # dealt by conversation and turn, so that no partition of the output is the work of one task
    rows.write.mode("overwrite").partitionBy("route", "bucket").parquet(output)
    read = said.agg(F.count("*").alias("turns_read"), F.count_if(F.expr("conv_id IS NULL OR turn IS NULL")).alias("turns_without_id")).first().asDict()
    read |= docs.agg(F.count("*").alias("documents_read"), F.count_if(F.col("doc_id").isNull()).alias("documents_without_id")).first().asDict()
    done = read | stored(spark, output, EVIDENCE).agg(F.count("*").alias("rows_written"), F.count_if(F.col("rank").isNotNull()).alias("hits"), F.count_if(F.col("route") == "suppressed").alias("suppressed")).first().asDict()
    log.info("turn_evidence: %s of %s and %s to %s", done, conversations, documents, output)
    return done


if __name__ == "__main__":
    main(evidence, PATHS)
