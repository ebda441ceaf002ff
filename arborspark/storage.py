"""Results that are computed once and kept where driver and executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def shared_folder(session: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only on a
    local master, as in tests, a temporary folder serves where it is unset."""
    where = session.conf.get("spark.checkpoint.dir", None)
    if where is None and session.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return where or tempfile.mkdtemp(prefix="checkpoints-")


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the reliable checkpoint folder, lineage cut.

    A checkpoint keeps the size that was estimated for its plan; over rounds of joins
    these estimates multiply into numbers of millions of digits, so the rows are
    given a plan of their own without one.
    """
    session = df.sparkSession
    sc = session.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(session))
    kept = df.checkpoint(eager=True)
    plain = kept._jdf.sparkSession().internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return type(kept)(plain, session)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder, computed once, and read from there."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows up to which a narrow table is sent to every task.
SMALL = 50_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if a count finds it small; a larger one is joined as
    Spark plans it. For tables of narrow rows that are already computed."""
    return broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
