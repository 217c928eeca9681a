"""What the jobs share: their command line, configuration and log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("lorespan.jobs")


def main(job: Callable[..., dict], paths: dict[str, str], argv: list[str] | None = None) -> dict:
    """Runs job(spark, **paths, **options): options come from the JSON file --config, paths from it or from arguments of their names."""
    parser = argparse.ArgumentParser(description=(job.__doc__ or "").splitlines()[0])
    parser.add_argument("--config", help="JSON file with options, and with paths that aren't given as arguments")
    for name, says in paths.items():
        parser.add_argument(f"--{name}", help=says)
    given = vars(parser.parse_args(argv))
    config = {}
    if file := given.pop("config"):
        with open(file, encoding="utf-8") as f:
            config = json.load(f)
    config |= {k: v for k, v in given.items() if v is not None}
    if missing := [name for name in paths if not config.get(name)]:
        parser.error(f"no path given for: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__name__).getOrCreate()
    try:
        return job(spark, **config)
    finally:
        spark.stop()


@contextmanager
def small_splits(spark: SparkSession, size: int) -> Iterator[None]:
    """Files are read in splits of at most these bytes meanwhile, for steps that take far longer than their reading: cores that are done early find more to do."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that a job writes; without rows as long as nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
