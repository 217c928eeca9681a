"""What each stage of a turn reports: rows of one run log, in the order of stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.sources.corpus import event_rows

#: Stages in order; the number of the answer's version belongs to the name of its stage.
STAGES = ("controller_decision", "retrieval_started", "retrieval_done", "utterance_end", "turn_classified", "sub_query_dispatched", "fusion_done", "answer", "uncertainty_flagged", "turn_complete")


def _named(rows: DataFrame, name: str, at: Column, *payload: str) -> DataFrame:
    return event_rows(rows, name, at, *payload)


def turn_events(answers: DataFrame, decided: DataFrame, spoken: DataFrame, run_id: str) -> DataFrame:
    """event, session_id, run_id, timestamp_s, wall_time, payload of turns: answers (as of answer_turns), decided (OUTPUT of the controller) and spoken (as of speculate). Times are those of the turn: decisions have their own, what follows its end has that of the end."""
    run = F.lit(run_id).alias("run_id")
    turn = F.concat_ws(":", "session_id", F.col("turn_id").cast("string"))
    heard = decided.where(F.col("decision").isin("wait", "provisional_retrieve", "retrieve")).withColumn("run_id", run)
    ends = heard.groupBy(turn.alias("turn_id")).agg(F.coalesce(F.min(F.when(F.col("decision") == "retrieve", F.col("t"))), F.max("t")).alias("ended_at"), F.max_by("buffer", "seq").alias("said"))
    rows = answers.withColumn("run_id", run).join(ends, "turn_id", "left").withColumn("at", F.coalesce("ended_at", F.lit(0.0)))
    early = spoken.join(answers.select("turn_id", "session_id"), "turn_id").withColumn("run_id", run).withColumn("trigger", F.lit("provisional")).withColumn("chunk_ids", F.transform("found", lambda x: x["chunk_id"]))
    searched = rows.where("kind != 'suppressed'").withColumn("trigger", F.when(F.col("kind") == "refine", "refine").otherwise("multi_intent"))
    complete = _named(rows, "turn_complete", F.col("at"), "turn_id", "kind", "answer", "citations", "answer_version", "calls", "usd")
    answered = _named(searched, "answer", F.col("at"), "turn_id", "answer_version", "claims", "kind").withColumn("event", F.concat(F.lit("answer_v"), F.get_json_object("payload", "$.answer_version")))
    parts = (
        _named(heard.withColumn("turn", turn), "controller_decision", F.col("t"), "turn", "decision", "reason", "buffer", "entities", "growth", "drift"),
        _named(early, "retrieval_started", F.col("at"), "turn_id", "trigger", "query"),
        _named(early, "retrieval_done", F.col("at"), "turn_id", "trigger", "query", "chunk_ids"),
        _named(rows, "utterance_end", F.col("at"), "turn_id", "utterance"),
        _named(rows, "turn_classified", F.col("at"), "turn_id", "kind", "reason"),
        _named(searched, "sub_query_dispatched", F.col("at"), "turn_id", "sub_queries"),
        _named(searched, "retrieval_started", F.col("at"), "turn_id", "trigger", "utterance"),
        _named(searched, "fusion_done", F.col("at"), "turn_id", "retrieved"),
        answered,
        _named(rows.where("uncertainty is not null"), "uncertainty_flagged", F.col("at"), "turn_id", "uncertainties"),
        complete,
    )
    return reduce(DataFrame.unionByName, parts)
