"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table of at most so many rows and so many bytes on disk is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: A key that holds more than one part in so many of the looked-up weight is hot.
HOT_PARTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``.

    Only a session on one machine may have none; it gets a temporary folder. On a cluster that would be another folder
    on each machine, so there a missing setting is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='cloudspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], None]]:
    """Tables that are materialized within are deleted at the end, but for those handed to the function that is given."""
    tables: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(tables)
    try:
        yield kept.append
    finally:
        _scratch[:] = [t for t in _scratch if t is not tables]
        discard(*[t for t in tables if not any(t is k for k in kept)])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, and what has been written outlives any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    for tables in _scratch:
        tables.append(out)
    return out


def _at(df: DataFrame) -> tuple[Any, Any]:
    """File system and path of a materialized table."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        files, path = _at(df)
        files.delete(path, True)


def is_small(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a materialized table may be broadcast: by its bytes on disk and its rows."""
    files, path = _at(table)
    return files.getContentSummary(path).getLength() <= max_bytes and table.count() <= max_rows


_resident: dict[str, Any] = {}


def resident(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept by a Python worker for its next tasks. A worker serves one operator after the other
    and keeps one such object at a time, so models of operators that are done do not pile up."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def lookup(rows: DataFrame, small: DataFrame, key: str, weight: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` to ``small``, which has one row for each key and how many rows look it up in ``weight``.

    ``small`` must be materialized and is broadcast if ``is_small``. Beyond that only its hot keys are: those with more
    than one part in HOT_PARTS of the total weight, so fewer than HOT_PARTS rows at any size of input. Rows with
    another key hold a small share each and are joined by shuffle. ``rows`` should be cheap to read twice.
    """
    if is_small(small, max_rows):
        return rows.join(F.broadcast(small), key, "left")
    total = small.agg(F.sum(weight)).first()[0]
    is_hot = F.col(weight) * HOT_PARTS > F.lit(total)
    hot = small.filter(is_hot)
    cold = small.filter(~is_hot)
    keys = F.broadcast(hot.select(key))
    return (
        rows.join(keys, key, "left_semi")
        .join(F.broadcast(hot), key, "left")
        .unionByName(rows.join(keys, key, "left_anti").join(cold, key, "left"))
    )


def whole_text(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))
