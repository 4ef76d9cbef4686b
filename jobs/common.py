"""What the jobs' command lines share: configurations, sessions and the log."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession

log = logging.getLogger("siltstone.jobs")


def configuration(spark: SparkSession, path: str, known: set[str]) -> dict:
    """The object of a JSON file at any path that Spark reads; names that the job doesn't know are errors."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = set(found) - known
    if unknown:
        raise ValueError(f"{path} has unknown names {sorted(unknown)}")
    return found


def parser(description: str, module: str, *paths: str) -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(description=description)
    for name in paths:
        made.add_argument(f"--{name}", required=True)
    made.add_argument("--config", default=os.path.splitext(os.path.abspath(module))[0] + ".json")
    return made


def session(name: str) -> SparkSession:
    """For command lines alone: master and memory are spark-submit's."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
