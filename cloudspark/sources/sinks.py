"""Writers. Each returns the rows (ord, value) of a text file; ``write`` stores them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ("id", "x", "y", "z", "fc", "r", "g", "b")
STATISTICS = ("nc", "rad", "abn", "dfp", "asp", "dim", "over", "slo")


def _number(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double"))


def _point() -> Column:
    return F.concat_ws("  ", *[F.col(c).cast("string") if c in ("id", "r", "g", "b") else _number(c, 8) for c in POINT])


def point_lines(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("ord"), _point().alias("value"))


def facility_lines(facilities: DataFrame) -> DataFrame:
    """As points; each facility has a line of its own, where the original runs all together."""
    return point_lines(facilities)


def statistics_lines(facilities: DataFrame) -> DataFrame:
    whole = ("id", "r", "g", "b", "nc", "dim", "over")
    parts = [F.col(c).cast("string") if c in whole else _number(c, 6 if c == "slo" else 8) for c in (*POINT, *STATISTICS)]
    return facilities.select(F.col("id").alias("ord"), F.concat_ws("  ", *parts).alias("value"))


def id_lines(lists: DataFrame) -> DataFrame:
    """From (fid, clients): the facility's id and a colon, its clients, an empty line."""
    return lists.select(F.col("fid").alias("ord"), F.concat(F.col("fid").cast("string"), F.lit(":\n"), F.col("clients"), F.lit("\n")).alias("value"))


def map_lines(assignment: DataFrame) -> DataFrame:
    return assignment.select(F.col("id").alias("ord"), F.col("fid").cast("string").alias("value"))


def export_lines(rows: DataFrame) -> DataFrame:
    order = F.struct("cid", "ord")
    return rows.select(order.alias("ord"), F.concat_ws("\t", "id", "x", "y", "z").alias("value"))


def write(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Text files that hold the lines in order from one to the next; ``parts=1`` for a single file."""
    ordered = lines.repartitionByRange(parts, "ord") if parts else lines.repartitionByRange("ord")
    ordered.sortWithinPartitions("ord").select("value").write.mode("errorifexists").text(path)


def tile_list_lines(points: DataFrame, folder: str) -> DataFrame:
    """One line for each tile: its folder below ``folder``, in the order of ``tile_ord``, or of their names without it."""
    order = "tile_ord" if "tile_ord" in points.columns else "tile_id"
    return points.select("tile_id", F.col(order).alias("ord")).distinct().select("ord", F.concat(F.lit(f"{folder}/tile_id="), "tile_id").alias("value"))


def write_tiles(points: DataFrame, path: str, name: str) -> None:
    """Tiles (column tile_id) as text of points, a folder below ``path/tiles`` each, and ``path/<name>.list``, a folder whose text
    names one tile a line, in the order of ``tile_ord``. What exists is kept."""
    tiles = f"{path}/tiles"
    ordered = points.select("tile_id", "id", _point().alias("value")).repartition("tile_id").sortWithinPartitions("tile_id", "id")
    ordered.select("tile_id", "value").write.mode("errorifexists").partitionBy("tile_id").text(tiles)
    write(tile_list_lines(points, tiles), f"{path}/{name}.list", 1)
