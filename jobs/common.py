"""What both jobs' command lines share: a config file, plain path arguments, a session."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def settings(own: str, given: str | None = None) -> dict:
    """The job's own config file, with what another one changes."""
    out = json.loads(Path(own).with_suffix(".json").read_text())
    return out | (json.loads(Path(given).read_text()) if given else {})


def command_line(own: str, doc: str, job: Callable[..., dict], paths: dict[str, str]) -> None:
    """Runs ``job(spark, *paths, **settings)`` in a session of its own."""
    p = argparse.ArgumentParser(description=doc)
    for name, text in paths.items():
        p.add_argument(name, help=text)
    p.add_argument("--config", help="JSON file with settings that replace the job's own")
    p.add_argument("--set", action="append", default=[], metavar="NAME=JSON", help="one setting")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    options = settings(own, a.config) | {k: json.loads(v) for k, _, v in (x.partition("=") for x in a.set)}
    root = str(Path(own).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    spark = SparkSession.builder.appName(Path(own).stem).config("spark.executorEnv.PYTHONPATH", root).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, *[getattr(a, name) for name in paths], **options)
    finally:
        spark.stop()
