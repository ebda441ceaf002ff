"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.storage import once as cut  # noqa: F401

#: Word class of the corpus operators: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a narrow table is sent to every task.
SMALL = 50_000


def if_small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if a count finds it small; a larger one is
    joined as Spark plans it. For tables that are already computed."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def blocks_for(n_rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``n_rows`` rows."""
    return max(1, -(-n_rows // per_block))


