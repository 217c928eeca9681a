"""Reading and writing: markdown folders, JSON lines, the index, transcripts."""

from __future__ import annotations

import logging
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.functions.text import strip, word_list
from lorespan.operators.retrieval import Index, build
from lorespan.settings import DEFAULT, Settings

TRANSCRIPT = "session_id string, turn_id long, seq int, t double, text string, is_final boolean, silence_s double, kind string"
_LOG = logging.getLogger(__name__)
_TABLES = ("chunks", "postings", "terms", "stats", "vectors", "blocks")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name), title, path, raw of the *.md files of a folder. An empty or missing folder is an error."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    except AnalysisException as error:
        raise FileNotFoundError(f"no folder {folder}") from error
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no .md files in {folder}")
    first = F.split(strip(F.col("raw")), "\n")[0]
    title = strip(F.regexp_replace(first, r"^#{1,6}\s+", ""))
    return rows.select("doc_id", F.coalesce(F.nullif(title, F.lit("")), F.col("doc_id")).alias("title"), "path", "raw")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are passed over, a missing file has no rows."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions in a folder, the latest last."""
    where, files = _folder(spark, path)
    if not files.exists(where):
        return []
    found = [x.getPath().getName() for x in files.listStatus(where)]
    return sorted(n for n in found if n.startswith("v") and files.exists(_folder(spark, f"{path}/{n}/_COMPLETE")[0]))


def write_index(index: Index, path: str) -> None:
    """Stores an index as a new version, which counts from the moment that all its tables are there; then older ones go."""
    spark = index.chunks.sparkSession
    old = _versions(spark, path)
    name = f"v{time.time_ns():020d}"
    for table in _TABLES:
        getattr(index, table).write.parquet(f"{path}/{name}/{table}")
    mark, files = _folder(spark, f"{path}/{name}/_COMPLETE")
    files.create(mark).close()
    for x in old:
        files.delete(_folder(spark, f"{path}/{x}")[0], True)


def read_index(spark: SparkSession, path: str) -> Index:
    """The latest complete version of a stored index; an error if there is none."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no index in {path}")
    return Index(*(spark.read.parquet(f"{path}/{found[-1]}/{table}") for table in _TABLES))


def open_index(spark: SparkSession, path: str, chunks: DataFrame, settings: Settings = DEFAULT) -> Index:
    """The stored index, or, if it is missing or has other chunks or vectors of another length, one built of chunks and stored."""
    try:
        index = read_index(spark, path)
        one = index.vectors.select(F.size("vec").alias("n")).first()
        if one and one["n"] == settings.dim and index.chunks.count() == index.vectors.count() == chunks.count():
            return index
    except FileNotFoundError:
        pass
    write_index(build(chunks, settings), path)
    return read_index(spark, path)


def spoken(turns: DataFrame, words: int = 3, chunk_ms: int = 300, silence_s: float = DEFAULT.silence_s) -> DataFrame:
    """Transcript chunks of turns (session_id, turn_id, utterance): groups of words at a steady pace; the last one is final and followed by silence."""
    split_ = word_list(F.col("utterance"))
    n = F.ceil(F.size(split_) / words).cast("int")
    groups = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(split_, i * words + 1, F.lit(words)), " "))).otherwise(F.array().cast("array<string>"))
    rows = turns.select("session_id", "turn_id", n.alias("n"), F.posexplode(groups).alias("seq", "text"))
    last = F.col("seq") == F.col("n") - 1
    return rows.select("session_id", "turn_id", "seq", F.round(F.col("seq") * (chunk_ms / 1000), 3).alias("t"), "text", last.alias("is_final"), F.when(last, silence_s).otherwise(0.0).alias("silence_s"), F.lit("chunk").alias("kind"))


def buffers(transcript: DataFrame) -> DataFrame:
    """Adds buffer: the text of a turn up to each chunk."""
    so_far = Window.partitionBy("session_id", "turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return transcript.withColumn("buffer", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text")).over(so_far)), lambda x: x["text"]), " "))


def transcript_stream(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of transcript messages from JSON files."""
    return spark.readStream.schema(TRANSCRIPT).option("maxFilesPerTrigger", files_a_batch).json(folder)


def without_repeats(stream: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """A stream of transcript messages, each once, with a watermark on `at`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["session_id", "turn_id", "seq"])


def write_events(events: DataFrame, folder: str, batch: int | None = None) -> None:
    """Run logs: JSON lines by session. With the number of a stream's batch they are put in place of what an earlier try of it wrote; without, beside all others."""
    if batch is None:
        events.write.mode("append").partitionBy("session_id").json(folder)
        return
    numbered = events.withColumn("batch", F.lit(batch))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "session_id").json(folder)


def fan_out(stream: DataFrame, sinks: list, checkpoint: str, interval: str | None = None):
    """Starts a stream that hands each micro-batch and its number to all sinks. A sink that fails is logged and left out for the rest of this run; a new run tries all again.

    A batch can come again, with its number, after a failure; a sink that must have it once puts it in place of
    the first (as write_events does). With an interval ("2 seconds") the stream goes on until it is
    stopped; without, it ends with what is there.
    """
    alive = list(sinks)

    def each(batch: DataFrame, number: int) -> None:
        for sink in list(alive):
            try:
                sink(batch, number)
            except Exception:  # a reader that went away must not stop the others
                _LOG.exception("a sink failed on batch %d and gets no more of this run", number)
                alive.remove(sink)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def events_of(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col("event") == name)


def event_rows(rows: DataFrame, name: str, at: Column, *payload: str) -> DataFrame:
    """event, session_id, run_id, timestamp_s, wall_time, payload (JSON) of rows with session_id and run_id."""
    return rows.select(F.lit(name).alias("event"), "session_id", "run_id", F.round(at, 4).alias("timestamp_s"), F.unix_timestamp().cast("double").alias("wall_time"), F.to_json(F.struct(*payload)).alias("payload"))
