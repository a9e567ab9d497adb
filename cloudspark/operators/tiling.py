"""KD tiles: recursive median splits until no tile has more than ``most`` points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudspark.plans.storage import materialize

#: Rows of a tile up to which its median is taken from its values; more are first narrowed to a bucket of the histogram.
EXACT_ROWS, BUCKETS = 1 << 20, 1 << 10


def medians(points: DataFrame, axis: str, by: str = "tile", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(by, cut): the exact median of each tile, the mean of both middle values if there are two.

    No task holds the values of a large tile: a histogram of BUCKETS buckets, counted within partitions first, tells which
    bucket holds the middle ranks, and only its values are looked at, in a finer histogram while they are too many.
    """
    value = F.col(axis).cast("double")
    rows = points.select(F.col(by).alias("t"), value.alias("v")).dropna()
    # ranks from 0 of the middle values among the values from low to high
    state = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = state.select("t", F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank"), F.col("rank").alias("left"), "n", "low", "high")
    state = materialize(state, "ranks")
    while True:
        large = state.filter((F.col("n") > exact_rows) & (F.col("low") < F.col("high")))
        if large.isEmpty():
            break
        width = (F.col("high") - F.col("low")) / BUCKETS
        spot = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BUCKETS - 1))
        held = rows.join(large, "t").filter("v >= low AND v <= high")
        counts = held.groupBy("t", "rank", "left", spot.alias("bucket")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.expr("sum(m) OVER (PARTITION BY t, rank ORDER BY bucket) - m")
        narrowed = counts.withColumn("before", before).filter("left >= before AND left < before + m")
        narrowed = narrowed.select("t", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("m").alias("n"), "low", "high")
        state = materialize(state.filter((F.col("n") <= exact_rows) | (F.col("low") >= F.col("high"))).unionByName(narrowed), "ranks")
    known = state.filter("low >= high").select("t", "rank", F.col("low").alias("v"))
    left = state.filter("low < high")
    values = rows.join(left, "t").filter("v >= low AND v <= high").groupBy("t", "rank", "left").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = values.select("t", "rank", F.get("vs", F.col("left").cast("int")).alias("v"))
    return known.unionByName(found).groupBy("t").agg(F.avg("v").alias("cut")).withColumnRenamed("t", by)


def split_median(points: DataFrame, axis: str, by: str = "tile") -> DataFrame:
    """``points`` with ``side``: 0 up to the median of the axis in its tile, else 1."""
    cut = materialize(medians(points, axis, by), "cuts")
    return points.join(cut, by).withColumn("side", (F.col(axis) > F.col("cut")).cast("long")).drop("cut")


def kd_tiles(points: DataFrame, levels: int, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """``points`` with ``tile``, the path of ``levels`` splits along x, y, z in turn as a binary number from 1.

    The cuts of each level are written as a table of one row a tile; a level reads the points once and joins the cuts so
    far, so points are never moved and the number of scans grows with the levels.
    """
    names = points.columns
    out = points.withColumn("tile", F.lit(1).cast("long"))
    for depth in range(levels):
        axis = "xyz"[depth % 3]
        cut = materialize(medians(out, axis, "tile", exact_rows), "cuts").withColumnRenamed("cut", "__cut")
        placed = out.join(cut, "tile", "left")
        out = placed.select(*names, (F.col("tile") * 2 + F.coalesce(F.col(axis) > F.col("__cut"), F.lit(False)).cast("long")).alias("tile"))
    return out


def levels_for(n: int, most: int) -> int:
    """Levels after which median splits leave at most ``most`` of ``n`` points in a tile, ties aside."""
    levels = 0
    while n > most:
        n, levels = -(-n // 2), levels + 1
    return levels


def tile_names(tiled: DataFrame, prefix: str, levels: int) -> DataFrame:
    """``tiled`` with ``tile_id``, the name of its tile file: prefix, number, depth and axis of the last split."""
    return tiled.withColumn("tile_id", F.format_string(f"{prefix}_%d_{levels}_{levels % 3}", F.col("tile")))
