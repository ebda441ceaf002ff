"""Result tables: appended shards with the run's configuration beside them."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Mapping

from pyspark.sql import DataFrame

from .fasta import read_results


def commit() -> str | None:
    """The commit of the code in use, where it lies in a git folder."""
    try:
        here = os.path.dirname(os.path.abspath(__file__))
        return subprocess.run(["git", "-C", here, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def append(rows: DataFrame, path: str, config: Mapping[str, object] | None = None) -> None:
    """Adds rows to a CSV table (with headers) and, once, a one-row JSON of the run."""
    rows.write.mode("append").csv(path, header=True)
    if config is not None:
        text = json.dumps({"commit": commit(), **config}, sort_keys=True, default=str)
        rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{path.rstrip('/')}.config")


__all__ = ["append", "read_results"]
