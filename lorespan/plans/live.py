"""Live sessions end to end: messages, decisions, look-ups while people speak, answers, states.

`answer_live` does it for a table of messages. `serve` does it for a stream: decisions are made by a
stateful operator, and each micro-batch of them is written under its number, so that a batch that is run
again after a failure takes the place of its first try. Turns that end in a batch are answered from all
that was decided about them, and the states of their sessions are written beside the answers.

What a batch needs of those before it are the open turns and the sessions' states. Every so many batches
writes them as a whole, so a batch reads that and the few batches since, by their numbers, however
long the stream has been running.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.lineage import cut
from lorespan.operators.retrieval import Index
from lorespan.plans.turns import STATE, follow_sessions, speculate
from lorespan.settings import DEFAULT, Settings
from lorespan.streaming.controller import OUTPUT, RESET, live_turns, utterances


def _told(decided: DataFrame) -> DataFrame:
    """Decisions on speech, without those on turns that were dropped, and on nothing else."""
    dropped = decided.where("decision = 'dropped'").select("session_id", "turn_id").distinct()
    return decided.where(F.col("decision").isin("wait", "provisional_retrieve", "retrieve")).join(dropped, ["session_id", "turn_id"], "left_anti")


def _ended(decided: DataFrame) -> DataFrame:
    """turn_id, session_id, turn, utterance, ended_at, started_at of the turns among decisions."""
    rows = utterances(decided)
    return rows.select(F.concat_ws(":", "session_id", F.col("turn_id").cast("string")).alias("turn_id"), "session_id", F.col("turn_id").alias("turn"), "utterance", "ended_at", "started_at")


def answer_live(messages: DataFrame, index: Index, settings: Settings = DEFAULT, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, states, decisions) of messages (see controller.live_turns): what is decided starts look-ups, and the ends of turns use them. A turn that did not end is not answered. After a reset a session has no state, whatever it had before."""
    decided = cut(live_turns(messages, settings))
    return (*answer_decided(decided, index, settings, states), decided)


def answer_decided(decided: DataFrame, index: Index, settings: Settings = DEFAULT, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, states) of the turns that end among decisions."""
    spark = decided.sparkSession
    states = spark.createDataFrame([], STATE) if states is None else states
    # what comes before and after a reset are sessions of their own, by one name
    resets = decided.where(F.col("decision") == RESET).select("session_id", F.col("turn_id").alias("reset_at"))
    rows = _told(decided).join(resets.groupBy("session_id").agg(F.sort_array(F.collect_list("reset_at")).alias("resets")), "session_id", "left")
    part = F.coalesce(F.size(F.filter("resets", lambda x: x < F.col("turn_id"))), F.lit(0))
    rows = cut(rows.withColumn("part", F.greatest(part, F.lit(0))).drop("resets"))
    over = rows.where("decision = 'retrieve'").select("session_id", "turn_id").distinct()
    rows = cut(rows.join(over, ["session_id", "turn_id"], "left_semi"))
    named = rows.withColumn("session_id", F.concat_ws("\x1f", "session_id", F.col("part").cast("string"))).drop("part")
    spoken = cut(speculate(named, index, settings))
    before = states.withColumn("session_id", F.concat_ws("\x1f", "session_id", F.lit("0")))
    answers, after = follow_sessions(_ended(named), index, settings, spoken, before)
    name, number = F.split_part("session_id", F.lit("\x1f"), F.lit(1)), F.split_part("session_id", F.lit("\x1f"), F.lit(2)).cast("int")
    # the state of a session is that after its last reset, if there is one
    ends = resets.groupBy("session_id").agg(F.count("*").cast("int").alias("n_resets"))
    after = after.withColumn("part", number).withColumn("session_id", name).join(ends, "session_id", "left").where("part = coalesce(n_resets, 0)").drop("part", "n_resets")
    plain = F.concat_ws(":", name, F.element_at(F.split("turn_id", ":"), -1))
    return answers.withColumn("turn_id", plain).withColumn("session_id", name), after


#: Batches from one writing of all open turns and states to the next.
EVERY = 10
#: States, and decisions, with the time of the batch that wrote them, in seconds. A session that has no state any more has one of nulls.
SEEN, DECIDED = f"{STATE}, seen_at double", f"{OUTPUT}, seen_at double"


def _batches(spark: SparkSession, folder: str, name: str, schema: str, numbers: range) -> DataFrame:
    """Rows of these batches, with batch; no other is listed or read."""
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    paths = [f"{folder}/{name}/batch={n}" for n in numbers]
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/{name}").parquet(*paths)


def _since(number: int, every: int) -> tuple[range, range]:
    """(the batch before this one that last wrote a whole, if any; the batches after it and before this one)."""
    whole = (number - 1) // every * every
    return (range(whole, whole + 1), range(whole + 1, number)) if whole > 0 else (range(0), range(number))


def _last(states: DataFrame) -> DataFrame:
    rest = [c for c in states.columns if c not in ("session_id", "batch")]
    return states.groupBy("session_id").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("session_id", "x.*").where("answer_version is not null")


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each session in folder, of all batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/states")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STATE)
    return _last(spark.read.schema(f"{SEEN}, batch long").parquet(f"{folder}/states")).drop("seen_at")


def _before(spark: SparkSession, folder: str, number: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(decisions on turns that were open, perhaps with some on others; states; both with seen_at) before a batch."""
    whole, since = _since(number, every)
    open_turns = _batches(spark, folder, "open", DECIDED, whole).unionByName(_batches(spark, folder, "decisions", DECIDED, since)).drop("batch")
    return open_turns, _last(_batches(spark, folder, "all_states", SEEN, whole).unionByName(_batches(spark, folder, "states", SEEN, since)))


def take(batch: DataFrame, number: int, index: Index, folder: str, settings: Settings = DEFAULT, now: float | None = None, every: int = EVERY) -> None:
    """Writes a batch of decisions, the answers to turns that end in it and the states after them.

    With now (seconds), open turns and states of sessions that wrote nothing for their time to live aren't
    carried on by the next whole; without, nothing is forgotten.
    """
    spark = batch.sparkSession
    write = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    batch = cut(batch)
    seen = F.lit(now).cast("double").alias("seen_at")
    write(batch.select("*", seen), "decisions")
    earlier, held = _before(spark, folder, number, every)
    over = _told(batch).where("decision = 'retrieve'").select("session_id", "turn_id").distinct()
    touched = cut(earlier.drop("seen_at").join(over, ["session_id", "turn_id"], "left_semi").unionByName(batch))
    held = cut(held)
    answers, after = answer_decided(touched, index, settings, held.drop("seen_at"))
    write(answers, "answers")
    changed = batch.where(F.col("decision") == RESET).select("session_id").unionByName(answers.select("session_id")).distinct()
    empty = spark.createDataFrame([], STATE)
    gone = changed.join(after.select("session_id"), "session_id", "left_anti").select("session_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields[1:]))
    states = after.join(changed, "session_id", "left_semi").select(*empty.columns).unionByName(gone)
    write(states.select("*", seen), "states")
    if number and number % every == 0:
        new = _batches(spark, folder, "states", SEEN, range(number, number + 1)).drop("batch")
        kept = held.join(new.select("session_id"), "session_id", "left_anti").unionByName(new.where("answer_version is not null"))
        fresh = F.lit(True) if now is None else F.coalesce("seen_at", F.lit(now)) >= now - settings.session_ttl_s
        write(kept.where(fresh), "all_states")
        every_turn = earlier.unionByName(batch.select("*", seen))
        # a turn is over by a retrieve, a drop or a reset, or once its session says something in a later one
        closed = every_turn.where(F.col("decision").isin("retrieve", "dropped")).select("session_id", "turn_id")
        last = every_turn.groupBy("session_id").agg(F.max("turn_id").alias("_turn"), F.max("seen_at").alias("seen_at")).where(fresh).drop("seen_at")
        write(every_turn.join(closed.distinct(), ["session_id", "turn_id"], "left_anti").join(last, "session_id").where("turn_id = _turn").drop("_turn"), "open")


def serve(messages: DataFrame, index: Index, folder: str, settings: Settings = DEFAULT, expire: bool = True, interval: str | None = None):
    """Starts a query over a stream of messages that writes decisions, answers and states into folder, by batch. With an interval ("2 seconds") it goes on until it is stopped; without, it ends with what is there."""
    each = lambda batch, number: take(batch, number, index, folder, settings, time.time() if expire else None)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return live_turns(messages, settings, expire).writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
