"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows (80 bytes, or a path) is broadcast.
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder of ``spark.checkpoint.dir``.

    Only a session on one machine may go without the setting; on a cluster that is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='cloudspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts the lineage."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table of short rows, marked for broadcast if it is small. ``rows``: how many it has at most, if that is known."""
    rows = table.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
