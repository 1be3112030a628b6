"""What the jobs share: configuration, command line, logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("jobs")


def configured(defaults: dict, given: dict | None) -> dict:
    """defaults with what is given; a name or a kind of value that they don't have is an error."""
    out = dict(defaults)
    for name, value in (given or {}).items():
        if name not in defaults:
            raise ValueError(f"unknown setting {name!r}; known are {', '.join(sorted(defaults))}")
        if defaults[name] is not None and (type(value) is not type(defaults[name])):
            raise ValueError(f"setting {name!r} must be of type {type(defaults[name]).__name__}")
        out[name] = value
    return out


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and how many rows of it went by once it is written: no further pass."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def main(job: Callable[..., dict], paths: list[str], doc: str, argv: list[str] | None = None) -> int:
    """Reads the command line, starts a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=doc)
    for name in paths:
        parser.add_argument(f"--{name.replace('_', '-')}", required=True, help="a path that Spark can read or write")
    parser.add_argument("--config", help="a JSON file of settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    given = json.loads(Path(args.config).read_text()) if args.config else {}
    spark = SparkSession.builder.appName(job.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(job(spark, *(getattr(args, name) for name in paths), config=given), default=str))
    finally:
        spark.stop()
    return 0
