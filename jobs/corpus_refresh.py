"""Keeps the chunks of a growing corpus up to date: takes new files of documents, chunks what is new or changed, and leaves the rest.

    python -m jobs.corpus_refresh --config jobs/corpus_refresh.json --documents IN --output OUT --checkpoint DIR

IN is a folder (or file) of Parquet with doc_id, text and lang; files that are added later are taken by
the next run. OUT has three tables. `versions` says which batch brought a document's text last, by its
SHA-256; `chunks` has the chunks that each batch made, `encoded` their terms and vectors (4-byte floats), so that an index
(`index`) is put together without reading an old text again. All are partitioned by batch (chunks by language,
too) and written by dynamic partition overwrite, so a batch that failed and runs again replaces what it had
written. A batch's versions are written last and only chunks of a document's last version count
(`current`), so a half-written batch is never seen. OUT and DIR belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, small_splits, stored
from lorespan.functions.vectors import of_bytes
from lorespan.operators import chunking, retrieval
from lorespan.settings import DEFAULT, Settings

PATHS = {"documents": "folder or file of Parquet with documents", "output": "folder of the tables versions and chunks", "checkpoint": "folder of the stream's checkpoint"}
#: Bytes of chunks' files that a task encodes at most.
SPLIT = 16 << 20
VERSIONS = "doc_id string, digest string, batch long"
ENCODED = "chunk_id string, doc_id string, terms array<string>, vec binary, batch long"
CHUNKS = "chunk_id string, doc_id string, section string, text string, citation string, batch long, lang string"


def latest(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """doc_id, digest, batch of each document's last version, of batches before the given one."""
    rows = stored(spark, f"{output}/versions", VERSIONS)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("doc_id").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of all documents as of their last versions: chunk_id, doc_id, section, text, citation, lang."""
    rows = stored(spark, f"{output}/chunks", CHUNKS)
    return rows.join(latest(spark, output).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select("chunk_id", "doc_id", "section", "text", "citation", "lang")


def index(spark: SparkSession, output: str) -> retrieval.Index:
    """The search index of current(spark, output), of the terms and vectors that were stored with each batch."""
    base = stored(spark, f"{output}/encoded", ENCODED).join(latest(spark, output).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")
    return retrieval.assemble(current(spark, output), base.select("chunk_id", "terms", of_bytes()("vec").alias("vec")))


def put(rows: DataFrame, path: str, *by: str) -> None:
    """Writes rows into the partitions that they belong to, in place of what those hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(docs: DataFrame, output: str, batch: int, settings: Settings, delimiter: str) -> dict:
    """Writes chunks, what an index has of them, and versions of a batch of documents, and says how many it read and wrote."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    # of several texts of one document in a batch, the greatest counts; equal ones meet in the map tasks
    one = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("x"))
    one = one.select("doc_id", F.col("x.text").alias("raw"), F.col("x.lang").alias("lang"), F.sha2("x.text", 256).alias("digest"))
    known = latest(spark, output, batch).select("doc_id", F.col("digest").alias("_known"))
    changed = one.join(known, "doc_id", "left").where(~F.col("digest").eqNullSafe(F.col("_known"))).withColumn("batch", F.lit(batch).cast("long")).persist()
    try:
        # tasks are dealt by document, not by language, so a frequent language is written by many of them
        put(chunking.chunks(changed, settings, delimiter, keep=("batch", "lang")), f"{output}/chunks", "batch", "lang")
        new = stored(spark, f"{output}/chunks", CHUNKS).where(F.col("batch") == batch)
        with small_splits(spark, SPLIT):
            put(retrieval.encoded(new, settings, keep=("doc_id", "batch"), as_bytes=True), f"{output}/encoded", "batch")
        put(changed.select("doc_id", "digest", "batch"), f"{output}/versions", "batch")
        read = rows.agg(F.count("*").alias("read"), F.count_if(F.col("doc_id").isNull()).alias("without_id")).first().asDict()
        return {"batch": batch, **read, "changed": changed.count(), "chunks": new.count()}
    finally:
        changed.unpersist()


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, *, chunk_words: int = DEFAULT.chunk_words, min_chunk_words: int = DEFAULT.min_chunk_words, delimiter: str = chunking.BLANK_LINE, vectors: bool = True, digest: str = "blake2b", files_per_batch: int = 64) -> dict:
    """Chunks the documents of files that came since the last run, and ends; returns how many it read and wrote.

    Files are taken files_per_batch at a time, each once: the stream's checkpoint is the mark. A
    document whose text is as before makes no chunks; one with another text makes a new version, which
    replaces the chunks of the old one, even by none. Rows without doc_id are counted and left out;
    a null text is an empty one. A run without new files writes nothing. vectors and digest say which
    vectors are stored for the index; all runs into one output must agree on the options.
    """
    settings = Settings(chunk_words=chunk_words, min_chunk_words=min_chunk_words, use_dense=vectors, digest=digest)
    done: list[dict] = []

    def each(batch: DataFrame, number: int) -> None:
        done.append(take(batch, output, number, settings, delimiter))
        log.info("corpus_refresh: %s of %s to %s", done[-1], documents, output)

    # a stream takes a path of one file only if it is a pattern; this one matches the path and nothing else
    pattern = f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = {k: sum(d[k] for d in done) for k in ("read", "without_id", "changed", "chunks")} | {"batches": len(done)}
    log.info("corpus_refresh: ended, %s", total)
    return total


if __name__ == "__main__":
    main(refresh, PATHS)
