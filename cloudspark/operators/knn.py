"""k nearest neighbours, the point itself included, on a grid of cells that halve from level to level.

Points that lie on one place are cut to the ``k`` smallest ids, queries on one place are asked once, so no place is heavy.
A query starts on the smallest of its cells that holds ``k`` points: the k-th of these bounds how far its neighbours
can be. It then reads the cells that its ball touches, about 27, on the level where a cell is as wide as the ball's radius.
Both steps are equi-joins of queries with points on cells; heavy cells are cut into parts. Points are moved once for each
level that some query reads, and only the cells that are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudspark.plans.storage import materialize

AXES = ("x", "y", "z")
#: Points of a cell that are joined as one part.
PART = 1 << 12
#: Most bits of a cell's number on an axis; three axes share a long.
BITS = 21
#: A cell of the finest level with more points asks for finer cells.
HEAVY = 1 << 12


def _cell(at: tuple[Column, Column, Column]) -> Column:
    x, y, z = at
    return F.shiftleft(x, 2 * BITS).bitwiseOR(F.shiftleft(y, BITS)).bitwiseOR(z)


def _down(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def knn(points: DataFrame, k: int | str, queries: DataFrame | None = None, by: str | None = None, rooted: bool = False) -> DataFrame:
    """(qid, nid, d2, rank, x, y, z of the neighbour); ties by id. ``k``: a number or a column of the queries; at least 1 is
    taken. ``by``: a column of both tables; only points with the query's value are its neighbours, and it is returned.

    ``rooted``: neighbours whose distances, the roots of d2, are equal count as ties, also if d2 differs in its last bit.

    Fewer than k points give as many neighbours as there are. Null coordinates have no neighbours and are none.
    """
    length = "sqrt(d2)" if rooted else "d2"
    count = F.lit(k) if isinstance(k, int) else F.col(k)
    group = F.col(by).cast("string") if by else F.lit("")
    asked = points if queries is None else queries
    own = asked.select(F.col("id").alias("qid"), group.alias("g"), *[F.col(c).alias(f"q{c}") for c in AXES], F.greatest(count, F.lit(1)).cast("int").alias("k"))
    own = own.dropna(subset=["qx", "qy", "qz", "g"])
    given = points.select("id", group.alias("g"), *AXES).dropna(subset=[*AXES, "g"])
    ends = given.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{e}") for c in AXES for f, e in ((F.min, "min"), (F.max, "max"))])
    box = ends.join(own.agg(F.max("k").alias("most"))).first()
    kind = dict(asked.dtypes)[by] if by else None
    extra = [F.col("g").cast(kind).alias(by)] if by else []
    if not box.n or not box.most:
        return own.join(given.withColumnRenamed("id", "nid"), "g").limit(0).select("qid", "nid", F.lit(0.0).alias("d2"), F.col("k").alias("rank"), *AXES, *extra)
    low = {c: float(box[f"{c}min"]) for c in AXES}
    widest = max(max(float(box[f"{c}max"]) - low[c] for c in AXES), 1e-300)
    ranked = given.withColumn("r", F.expr("row_number() OVER (PARTITION BY g, x, y, z ORDER BY id)")).filter(F.col("r") <= box.most).drop("r")
    bits = min(BITS, max(1, math.ceil(math.log2(box.n) / 2) + 1))
    while True:
        smallest = widest / (1 << bits)

        def place(c: str, value: Column, smallest: float = smallest, bits: int = bits) -> Column:
            at = F.floor(F.least(F.greatest((value - low[c]) / smallest, F.lit(0.0)), F.lit(float((1 << bits) - 1))))
            return at.cast("long")

        placed = materialize(ranked.select("*", *[place(c, F.col(c)).alias(f"c{c}") for c in AXES]), "points")
        levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")
        at = lambda p: _cell(tuple(_down(F.col(f"{p}{c}"), F.col("level")) for c in AXES))
        cells = materialize(placed.select("g", "cx", "cy", "cz", levels).groupBy("g", "level", at("c").alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        if bits == BITS or cells.filter("level = 0").agg(F.max("n")).first()[0] <= HEAVY:
            break
        bits = BITS

    def near(wanted: DataFrame, bounded: bool) -> DataFrame:
        """The first k points of the cells (g, level, cell) that queries want, within their bound; one row of points a query."""
        parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))
        wanted = wanted.join(cells, ["g", "level", "cell"])
        read = wanted.select("g", "level", "cell", "n").distinct()
        used = [r.level for r in wanted.select("level").distinct().collect()]
        there = placed.select("g", "id", *AXES, "cx", "cy", "cz", F.explode(F.array(*[F.lit(x) for x in sorted(used)])).alias("level"))
        there = there.withColumn("cell", at("c")).drop("cx", "cy", "cz").join(read, ["g", "level", "cell"])
        there = there.withColumn("part", F.pmod(F.xxhash64("id"), F.floor((F.col("n") - 1) / PART) + 1)).drop("n")
        pairs = wanted.withColumn("part", F.explode(parts)).drop("n").join(there, ["g", "level", "cell", "part"])
        pairs = pairs.withColumn("d2", F.expr("(qx-x)*(qx-x)+(qy-y)*(qy-y)+(qz-z)*(qz-z)"))
        if bounded:
            pairs = pairs.filter(f"{length} <= {length.replace('d2', 'far')}")
        first = f"row_number() OVER (PARTITION BY g, qx, qy, qz ORDER BY {length}, id)"
        return pairs.select("g", "qx", "qy", "qz", "k", "id", *AXES, "d2", F.expr(first).alias("rank")).filter("rank <= k")

    places = own.groupBy("g", "qx", "qy", "qz").agg(F.max("k").alias("k"))
    places = places.select("*", *[place(c, F.col(f"q{c}")).alias(f"p{c}") for c in AXES])
    starts = places.select("*", levels).withColumn("cell", at("p")).join(cells, ["g", "level", "cell"])
    enough = F.when((F.col("n") >= F.col("k")) | (F.col("level") == bits), F.struct("level", "cell"))
    starts = starts.groupBy("g", "qx", "qy", "qz", "k").agg(F.min(enough).alias("s")).select("g", "qx", "qy", "qz", "k", "s.*")
    bound = near(materialize(starts, "starts"), False).groupBy("g", "qx", "qy", "qz", "k").agg(F.max("d2").alias("far"))
    reach = F.sqrt("far") * (1 + 1e-9)
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(reach / smallest, F.lit(1.0)))), F.lit(0)), F.lit(bits)).cast("int")
    balls = bound.withColumns({"reach": reach, "level": level})
    for c in AXES:  # the cells of an axis that the ball touches
        side = [_down(place(c, F.col(f"q{c}") + s * F.col("reach")), F.col("level")) for s in (-1, 1)]
        balls = balls.withColumn(f"p{c}", F.explode(F.sequence(*side)))
    touched = balls.withColumn("cell", _cell(tuple(F.col(f"p{c}") for c in AXES))).select("g", "qx", "qy", "qz", "k", "far", "level", "cell")
    found = near(materialize(touched, "balls"), True)
    found = materialize(found.drop("k"), "found").withColumnRenamed("id", "nid")
    return own.join(found, ["g", "qx", "qy", "qz"]).filter("rank <= k").select("qid", "nid", "d2", "rank", *AXES, *extra)
