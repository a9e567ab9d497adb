"""A regular grid over a cloud: bins, their neighbours, radius joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def extents(points: DataFrame) -> DataFrame:
    """One row: n and the least and largest value of each axis."""
    return points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in AXES for f, k in ((F.min, "min"), (F.max, "max"))])


def bins(lo: str, hi: str, size: float) -> str:
    """Number of bins of an axis, as SQL; at least one."""
    return f"greatest(cast(ceil(({hi}-{lo})/{size}) as bigint), 1)"


def index(c: str, size: float) -> str:
    """Bin of an axis, as SQL: bins are 1/0.99 of an even share wide. Null outside the extent, 0 for an axis without extent."""
    span = f"({c}max-{c}min)"
    return (
        f"(CASE WHEN {c} < {c}min OR {c} > {c}max THEN NULL WHEN {span} = 0 THEN cast(0 as bigint) "
        f"ELSE cast(floor(0.99*{bins(c + 'min', c + 'max', size)}*({c}-{c}min)/nullif({span}, 0)) as bigint) END)"
    )


def with_index(points: DataFrame, size: float) -> DataFrame:
    """``points`` with ix, iy, iz and the one-dimensional index ``cell``; one row of extents is broadcast."""
    e = extents(points).drop("n")
    n = {c: bins(f"{c}min", f"{c}max", size) for c in AXES}
    out = points.join(F.broadcast(e)).select(*points.columns, *[F.expr(index(c, size)).alias(f"i{c}") for c in AXES], *[F.expr(n[c]).alias(f"n{c}") for c in AXES])
    return out.withColumn("cell", F.expr("ix + iy*nx + iz*nx*ny"))


def cells(points: DataFrame, width: float) -> DataFrame:
    """``points`` with an unbounded grid of exact ``width`` from the origin: cx, cy, cz."""
    return points.select("*", *[F.floor(F.col(c) / width).alias(f"c{c}") for c in AXES])


def around(c: Column) -> Column:
    return F.array(c - 1, c, c + 1)


def spread(points: DataFrame, keys: tuple[str, str, str]) -> DataFrame:
    """Each row once for each of the 27 cells around its own, whose keys replace its own."""
    for k in keys:
        points = points.withColumn(k, F.explode(around(F.col(k))))
    return points


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (aid, oid, d) of points at most ``radius`` apart, an equi-join on cells as wide as the radius.

    The right side is spread to its 27 neighbouring cells; give it the smaller table.
    """
    a = cells(left, radius).select(F.col("id").alias("aid"), *[F.col(c).alias(f"a{c}") for c in AXES], "cx", "cy", "cz")
    b = spread(cells(right, radius).select(F.col("id").alias("oid"), *[F.col(c).alias(f"o{c}") for c in AXES], "cx", "cy", "cz"), ("cx", "cy", "cz"))
    from cloudspark.functions.metrics import l2

    return a.join(b, ["cx", "cy", "cz"]).withColumn("d", F.expr(l2())).filter(F.col("d") <= radius).drop("cx", "cy", "cz")


def serpentine(layer: Column, row: Column, column: Column, n: int) -> Column:
    """Rank, from 1, of a cell of ``n`` rows and columns on a path that turns at the end of each row and of each layer.

    Rows are walked backwards on odd layers, columns backwards on every other row walked.
    """
    walked = F.when(layer % 2 == 0, row).otherwise(n - 1 - row)
    step = F.when((layer + row) % 2 == 0, column).otherwise(n - 1 - column)
    return (layer * n + walked) * n + step + 1


def serpentine_bins(points: DataFrame, n: int) -> DataFrame:
    """``points`` with ``bin``, its rank on the path through ``n`` bins an axis: layers by z, rows by y, columns by x. All
    points are in bin 1 if an axis has no extent."""
    box = extents(points).drop("n")
    flat = reduce(lambda a, b: a | b, [F.col(f"{c}max") == F.col(f"{c}min") for c in AXES])

    def place(c: str) -> Column:
        part = (F.col(c) - F.col(f"{c}min")) / F.nullif(F.col(f"{c}max") - F.col(f"{c}min"), F.lit(0.0))
        return F.when(flat, 0).otherwise(F.floor(part * (0.99 * n))).cast("long")

    return points.join(F.broadcast(box)).select(*points.columns, serpentine(place("z"), place("y"), place("x"), n).alias("bin"))


def with_index_by_count(points: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """As ``with_index``, by the number of bins of each axis."""
    e = extents(points).drop("n")
    cols = []
    for c, n in zip(AXES, (nx, ny, nz), strict=True):
        span = F.col(f"{c}max") - F.col(f"{c}min")
        at = F.when(span == 0, 0).otherwise(F.floor((F.col(c) - F.col(f"{c}min")) / F.nullif(span, F.lit(0.0)) * (0.99 * n))).cast("long")
        cols.append(at.alias(f"i{c}"))
    out = points.join(F.broadcast(e)).select(*points.columns, *cols)
    return out.withColumn("cell", F.col("ix") + F.col("iy") * nx + F.col("iz") * (nx * ny))


def locate(queries: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """``queries`` with ix, iy, iz in the grid of ``points``; -1 on an axis along which a query lies outside."""
    e = extents(points).drop("n")
    out = queries.join(F.broadcast(e))
    return out.select(*queries.columns, *[F.coalesce(F.expr(index(c, size)), F.lit(-1).cast("long")).alias(f"i{c}") for c in AXES])
