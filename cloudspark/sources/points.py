"""Readers: point clouds by row width, tile lists, cluster and centroid files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudspark.plans.storage import lookup, materialize

#: Columns by row width, without and with ids in the file.
WIDTHS = {
    3: (("x", "y", "z"),) * 2,
    4: (("x", "y", "z", "fc"), ("id", "x", "y", "z")),
    6: (("x", "y", "z", "r", "g", "b"),) * 2,
    7: (("x", "y", "z", "fc", "r", "g", "b"), ("id", "x", "y", "z", "r", "g", "b")),
    8: (("id", "x", "y", "z", "fc", "r", "g", "b"),) * 2,
}


def parse_points(lines: DataFrame, fc: float = 1.0, multiplier: float = 1.0, non_uniform: bool = False, with_ids: bool = False, strict: bool = False) -> DataFrame:
    """Rows (pos, value) to id, x, y, z, fc, r, g, b; other columns of ``lines`` stay.

    The width of a row says what it holds; rows of another width are skipped but have used their line number. The id
    is the line number where the row has none. Rows with a token that is no number are dropped (``bad_rows`` has them), or
    fail if ``strict``.
    """
    more = [c for c in lines.columns if c not in ("pos", "value", "id", "x", "y", "z", "fc", "r", "g", "b")]
    wide = _wide(lines, with_ids, strict)
    needed = ["x", "y", "z"]
    own = F.coalesce("fc", F.lit(fc)) if non_uniform else F.lit(fc)
    rgb = [F.coalesce(F.col(c), F.lit(0.0)).cast("short").alias(c) for c in "rgb"]
    good = wide if strict else wide.filter(~F.col("bad"))
    return good.select(F.coalesce(F.col("id").cast("long"), "pos").alias("id"), *needed, (own * multiplier).alias("fc"), *rgb, *more)


def bad_rows(lines: DataFrame, with_ids: bool = False) -> DataFrame:
    """(pos, value) of the rows of a known width that ``parse_points`` drops since a token is no number."""
    return _wide(lines, with_ids, False).filter("bad").select("pos", "value")


def _wide(lines: DataFrame, with_ids: bool, strict: bool) -> DataFrame:
    """``lines`` with a number for each column, null if the row has none, and whether a token is no number."""
    rows = lines.withColumn("t", F.split(F.trim(F.translate("value", "\t", " ")), " +")).filter(F.size("t").isin(list(WIDTHS))).filter("t[0] <> ''")
    cast = (lambda c: c.cast("double")) if strict else (lambda c: c.try_cast("double"))

    def pick(name: str):
        out = F.lit(None).cast("double")
        for width, kinds in WIDTHS.items():
            if name in (columns := kinds[with_ids]):
                out = F.when(F.size("t") == width, cast(F.try_element_at("t", F.lit(columns.index(name) + 1)))).otherwise(out)
        return out

    names = ("id", "x", "y", "z", "fc", "r", "g", "b")
    wide = rows.select("*", *[pick(c).alias(c) for c in names])
    return wide.withColumn("bad", F.exists("t", lambda x: x.try_cast("double").isNull())).drop("t")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, pos, value): lines of text files, numbered from 0 in each file.

    Files are read in splits of any size: rows of a split are numbered by their place in it, and each split starts where
    those before it in the file end. One row a split tells how many there are.
    """
    scan = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    splits = scan.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    splits = splits.withColumn("before", F.expr("sum(n) OVER (PARTITION BY path ORDER BY split) - n")).drop("n")
    return scan.join(splits, ["path", "split"]).select("path", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "value")


def read_points(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_points(read_lines(spark, path).select("pos", "value"), **options)


def read_tile_list(spark: SparkSession, list_path: str) -> list[str]:
    """Paths of the tiles in the order of the list; a tile list names files, one a tile."""
    base = list_path.replace("\\", "/").rsplit("/", 1)[0]
    names = [r.value.strip().replace("\\", "/") for r in read_lines(spark, list_path).orderBy("path", "pos").collect() if r.value.strip()]
    return [x if x.startswith("/") or ":" in x else f"{base}/{x}" for x in names]


def _tile_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removeprefix("tile_id=")


def read_tiles(spark: SparkSession, list_path: str, only: list[str] | None = None, own_ids: bool = False, **options) -> DataFrame:
    """All tiles of a tile list, or those named in ``only``, with tile_id (the name of the tile's file or folder).

    Rows without an id of their own get one that is unique over the tiles: they are numbered on from tile to tile in the
    order of the list. Ids that rows have are taken as they are and must be unique. ``own_ids``: all rows have one (8 columns, or
    ``with_ids``), so no line is counted, and no file of another tile than those in ``only`` is opened; rows that have none are left out.
    A name that is not in the list is an error.
    """
    paths = read_tile_list(spark, list_path)
    if only is not None and (unknown := set(only) - {_tile_name(x) for x in paths}):
        raise ValueError(f"not in {list_path}: {', '.join(sorted(unknown))}")
    wanted = paths if only is None else [x for x in paths if _tile_name(x) in set(only)]
    if not wanted:
        raise ValueError("name at least one tile")
    if own_ids:
        lines = spark.read.text(wanted).select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("long").alias("pos"), "value")
        return parse_points(_with_tile(lines).drop("path"), **options).filter("id IS NOT NULL")
    lines = _with_tile(read_lines(spark, paths))
    order = spark.createDataFrame([(_tile_name(x), i) for i, x in enumerate(paths)], "tile_id string, ord long").dropDuplicates(["tile_id"])
    sizes = lines.groupBy("path", "tile_id").agg(F.count(F.lit(1)).alias("n")).join(order, "tile_id", "left")
    starts = materialize(sizes.withColumn("before", F.expr("sum(n) OVER (ORDER BY ord, tile_id, path) - n")).select("path", "before"), "starts")
    if only is not None:
        lines = _with_tile(read_lines(spark, wanted))
    numbered = lines.join(lookup(starts), "path").select((F.col("pos") + F.col("before")).alias("pos"), "value", "tile_id")
    return parse_points(numbered, **options)


def _with_tile(lines: DataFrame) -> DataFrame:
    """``lines`` (path and others) with tile_id; a tile that was written by Spark is a folder of part files."""
    parts = F.split("path", "/")
    name = F.when(F.startswith(F.element_at(parts, -1), F.lit("part-")), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    return lines.withColumn("tile_id", F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "^tile_id=", ""))


#: Lines of a cluster file that are searched for a cluster's head together.
BLOCK_LINES = 1 << 16


def parse_clusters(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Rows (pos, value) to (cid, ord, id): a line ``<cid>:`` starts a cluster, the next lines list ids; ``#`` comments.

    A line's head is the last one before it in its block, or the last one of the blocks before, which are one row each.
    """
    own = lines.withColumn("value", F.trim("value")).filter("value <> '' AND NOT startswith(value, '#')")
    is_head = F.contains("value", F.lit(":"))
    head = F.when(is_head, F.expr("try_cast(trim(split_part(value, ':', 1)) as bigint)"))
    rows = own.select("pos", "value", F.floor(F.col("pos") / block_lines).alias("block"), head.alias("head"))
    last = rows.groupBy("block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("pos"))).alias("head"))
    carried = last.select("block", F.expr("last(head, true) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("carried"))
    found = F.coalesce(F.expr("last(head, true) OVER (PARTITION BY block ORDER BY pos)"), F.col("carried"))
    members = rows.join(lookup(materialize(carried, "heads")), "block").withColumn("cid", found).filter(F.col("head").isNull() & F.col("cid").isNotNull())
    tokens = members.select("cid", "pos", F.posexplode(F.split("value", "\\s+")).alias("at", "token"))
    return tokens.select("cid", F.expr("row_number() OVER (PARTITION BY cid ORDER BY pos, at)").cast("long").alias("ord"), F.expr("try_cast(token as bigint)").alias("id")).dropna()


def parse_centroids(lines: DataFrame, column: int = 0) -> DataFrame:
    """Rows (pos, value) to cid, the number in the 0-based ``column``; rows without it are skipped."""
    token = F.try_element_at(F.split(F.trim("value"), "\\s+"), F.lit(column + 1))
    return lines.select(token.try_cast("double").cast("long").alias("cid")).dropna()
