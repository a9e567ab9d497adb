"""Trees of boxes over a cloud, grown level by level: tiles of bounded size, nearest neighbours and distances of regions by bounds.

A node is named by its path, a digit for each split: 0 below the cut, 1 above it, or the sum of 1, 2 and 4 for the axes
above whose middle a point lies, where all axes are halved at once. Each node stops on its own, once it holds no
more points than asked for, so a tree is as deep as the cloud is dense. A level takes one aggregation by node, which is combined
within partitions first, and one join with the cuts; every fourth level the points' paths are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudspark.operators.tiling import medians
from cloudspark.plans.storage import lookup, materialize

AXES = ("x", "y", "z")
#: Points of a leaf of a search tree; levels after which paths are written.
LEAF, WRITE = 32, 4
#: Places of queries that a task takes down a tree: each becomes some fifty boxes on the way, which a size in bytes does not tell.
QUERIES = 1 << 11


def _extents(points: DataFrame) -> DataFrame:
    """(g, path, n, least and largest value of each axis and of the id)."""
    ends = [f(c).alias(f"{c}{e}") for c in (*AXES, "id") for f, e in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy("g", "path").agg(F.count(F.lit(1)).alias("n"), *ends)


def _chosen(nodes: DataFrame, rule: str) -> DataFrame:
    """``nodes`` with ``axis``: x, y, z, ``id`` where points differ in nothing else, or null if a node can't be split.

    ``median`` takes the axes in turn and skips those without extent; ``middle`` gives the widest one, which is halved
    with all that are at least half as wide; ``middle, ids`` goes on with ids where points lie on one place.
    """
    span = {c: F.coalesce(F.col(f"{c}max") - F.col(f"{c}min"), F.lit(0.0)) for c in AXES}
    if rule != "median":
        one_place = F.when(F.col("idmax") > F.col("idmin"), "id") if rule == "middle, ids" else F.lit(None)
        axis = F.when(F.greatest(*span.values()) <= 0, one_place)
        for c in AXES:
            axis = axis.when(span[c] == F.greatest(*span.values()), c)
        return nodes.withColumn("axis", axis)
    by_turn = F.when(F.lit(False), None)
    for turn in range(3):
        for c in AXES[turn:] + AXES[:turn]:
            by_turn = by_turn.when((F.length("path") % 3 == turn) & (span[c] > 0), c)
    return nodes.withColumn("axis", by_turn.when(F.col("idmax") > F.col("idmin"), "id"))


def _value(axis: str, of: str = "") -> Column:
    out = F.when(F.col(axis) == "id", F.col(f"{of}id").cast("double"))
    for c in AXES:
        out = out.when(F.col(axis) == c, F.col(f"{of}{c}").cast("double"))
    return out


def _ends(axis: str, end: str) -> Column:
    out = F.when(F.col(axis) == "id", F.col(f"id{end}").cast("double"))
    for c in AXES:
        out = out.when(F.col(axis) == c, F.col(f"{c}{end}").cast("double"))
    return out


def grow(points: DataFrame, most: int, rule: str = "median") -> tuple[DataFrame, DataFrame]:
    """``points`` (g, id, x, y, z and others) with ``path``, and all nodes (g, path, n, extents, leaf).

    ``median``: a node is cut at the median of its axis; what lies on the cut goes below, unless the cut is the largest value
    there is, when it goes above. So both sides have points, and no leaf has more than ``most``, ties included: points on one place
    are split by their ids. A null coordinate lies below. ``middle``: a node's wide axes are halved at once; points on one place stay together.
    ``middle, ids``: those are split by halving the range of their ids, which are longs.
    """
    names = points.columns
    at = materialize(points.withColumn("path", F.lit("")), "paths")
    nodes: DataFrame | None = None
    depth = 0
    while True:
        level = at if nodes is None else at.filter(F.length("path") == depth)
        found = _chosen(_extents(level), rule)
        found = materialize(found.withColumn("leaf", (F.col("n") <= most) | F.col("axis").isNull()), "level")
        nodes = found if nodes is None else nodes.unionByName(found)
        split = found.filter("NOT leaf")
        n = split.count()
        if not n:
            return at, nodes
        if rule == "median":
            cuts = split.select("g", "path", "axis", _ends("axis", "max").alias("high"))
            values = level.join(lookup(cuts, n), ["g", "path"]).select(F.struct("g", "path").alias("node"), _value("axis").alias("v"))
            middle = medians(values, "v", "node").select("node.*", "cut")
            cuts = materialize(cuts.join(middle, ["g", "path"]).select("g", "path", F.struct("axis", "cut", (F.col("cut") >= F.col("high")).alias("at_end")).alias("at")), "cuts")
            v = _value("at.axis", "row.")
            above = (v > F.col("at.cut")) | (F.col("at.at_end") & (v == F.col("at.cut")))
            digit = F.when(F.coalesce(above, F.lit(False)), 1).otherwise(0)
        else:
            widest = F.greatest(*[F.col(f"{c}max") - F.col(f"{c}min") for c in AXES])
            # what lies on the middle goes below, and so does the largest value if the middle is rounded up to it
            halves = [F.when((F.col(f"{c}max") - F.col(f"{c}min")) * 2 >= widest, F.col(f"{c}min") + (F.col(f"{c}max") - F.col(f"{c}min")) / 2) for c in AXES]
            halves = [F.when(half < F.col(f"{c}max"), half).otherwise(F.when(half.isNotNull(), F.col(f"{c}min"))).alias(c) for c, half in zip(AXES, halves, strict=True)]
            digit = sum((F.when(F.col(f"row.{c}") > F.col(f"at.{c}"), 1 << i).otherwise(0) for i, c in enumerate(AXES)), F.lit(0))
            if rule == "middle, ids":  # halves before the sum, which could pass a long
                half = F.expr("CASE WHEN axis = 'id' THEN greatest(idmin, least(idmax - 1, idmin div 2 + idmax div 2)) END")
                halves = [*halves, half.alias("id")]
                digit += F.when(F.col("row.id") > F.col("at.id"), 1).otherwise(0)
            cuts = split.select("g", "path", F.struct(*halves).alias("at"))
        placed = at.select(F.struct(*names).alias("row"), "g", "path").join(lookup(cuts, n), ["g", "path"], "left")
        at = placed.select("row.*", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat("path", digit.cast("string"))).alias("path"))
        depth += 1
        if depth % WRITE == 0:
            at = materialize(at, "paths")


def tiles(points: DataFrame, most: int, prefix: str = "tile") -> DataFrame:
    """``points`` with ``tile_id`` and ``tile_ord``: tiles of at most ``most`` points, ties included, each with its own depth.

    The name of a tile is the prefix, its number, its depth and its axis in turn. A stack numbers the nodes: the last one
    in is taken first, and its two halves get the next numbers, the lower half first. ``tile_ord`` is the place, from 0, in
    the list of tiles, in which they leave the stack.
    """
    at, nodes = grow(points.select(F.lit(0).alias("g"), "id", *AXES, F.struct("*").alias("point")), most)
    # taken from the stack: the upper half and all below it before the lower half
    taken = F.translate("path", "01", "10")
    nodes = materialize(nodes.select("path", "leaf", taken.alias("taken")), "nodes")
    inner = nodes.filter("NOT leaf").select("path", F.expr("row_number() OVER (ORDER BY taken)").alias("split"))
    leaves = nodes.filter("leaf").select("path", F.expr("row_number() OVER (ORDER BY taken) - 1").cast("long").alias("tile_ord"))
    parent, half = F.expr("left(path, length(path) - 1)"), F.expr("cast(right(path, 1) as bigint)")
    numbered = leaves.select("*", parent.alias("up"), half.alias("half")).join(inner.select(F.col("path").alias("up"), "split"), "up", "left")
    number = F.coalesce(F.col("split") * 2 - 1 + F.col("half"), F.lit(0)).cast("long")
    depth = F.length("path")
    named = numbered.select("path", F.format_string(f"{prefix}_%d_%d_%d", number, depth, depth % 3).alias("tile_id"), "tile_ord")
    return at.join(lookup(materialize(named, "tiles")), "path").select("point.*", "tile_id", "tile_ord")


def _box(p: str) -> list[str]:
    return [f"{p}{c}{e}" for c in AXES for e in ("min", "max")]


def _nearest(p: str, box: str) -> Column:
    """Squared distance of a place (or of a box, if ``p`` ends in a dot) from a box, 0 within."""
    low, high = (lambda c, e: F.col(f"{p}{c}")), (lambda c, e: F.col(f"{p}{c}"))
    if p.endswith("_"):
        low = high = lambda c, e: F.col(f"{p}{c}{e}")
    gaps = [F.greatest(F.col(f"{box}{c}min") - high(c, "max"), low(c, "min") - F.col(f"{box}{c}max"), F.lit(0.0)) for c in AXES]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def _farthest(p: str, box: str) -> Column:
    """Squared distance of the two farthest places of a place (or box) and a box."""
    end = (lambda c, e: F.col(f"{p}{c}{e}")) if p.endswith("_") else (lambda c, e: F.col(f"{p}{c}"))
    far = [F.greatest(F.abs(F.col(f"{box}{c}max") - end(c, "min")), F.abs(end(c, "max") - F.col(f"{box}{c}min"))) for c in AXES]
    return far[0] * far[0] + far[1] * far[1] + far[2] * far[2]


#: What a bound loses to rounding.
SLACK = 1 + 1e-12
#: What a search knows of a node's points: their box and their least and largest id.
BOUNDS = (*_box(""), "idmin", "idmax")


def search_tree(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Points with the ``path`` of their leaf; the tops (g, path, leaf, n, extents) of the groups; all other nodes, with ``up``, the node
    they are part of; and the depth of the deepest."""
    at, nodes = grow(points, leaf, "middle")
    at, nodes = materialize(at, "leaves"), materialize(nodes.select("g", "path", "leaf", "n", *BOUNDS), "nodes")
    deep = F.length("path")
    up = F.expr("left(path, length(path) - 1)")
    return at, nodes.filter(deep == 0), nodes.filter(deep > 0).withColumn("up", up), nodes.agg(F.max(deep)).first()[0] or 0


def knn(
    points: DataFrame, k: int | str, queries: DataFrame | None = None, by: str | None = None, leaf: int = LEAF, radius: float | None = None, eps: float = 0.0, count_leaves: bool = False
) -> DataFrame:
    """(qid, nid, d2, rank, x, y, z of the neighbour); ties by id. ``k``: a number or a column of the queries; at least 1 is
    taken. ``by``: a column of both tables; only points with the query's value are its neighbours, and it is returned.

    A search goes down the tree for all queries at once. The largest distances of the boxes that hold k points bound a query's k-th
    neighbour, and boxes that begin beyond are left. Of the leaves that remain those that begin first are read, up
    to k points; the k-th of these is the bound for all others. So a query reads the leaves that its neighbours' ball meets and
    few more, however points are spread.

    ``radius``: only points nearer than that are neighbours. ``eps``: each distance may be up to 1 + eps times the true one of its
    rank. Of the leaves beyond the first only those are read that begin within the bound divided by 1 + eps: a point that
    is left out for that is farther than that, and no distance returned is beyond the bound. ``count_leaves`` adds ``leaves``, how
    many the query has read.

    Fewer than k points give as many neighbours as there are. Null coordinates have no neighbours and are none.
    """
    count = F.lit(k) if isinstance(k, int) else F.col(k)
    group = F.col(by).cast("string") if by else F.lit("")
    asked = points if queries is None else queries
    own = asked.select(F.col("id").alias("qid"), group.alias("g"), *[F.col(c).cast("double").alias(f"q{c}") for c in AXES], F.greatest(count, F.lit(1)).cast("int").alias("k"))
    own = own.dropna(subset=["qx", "qy", "qz", "g"])
    given = points.select("id", group.alias("g"), *[F.col(c).cast("double") for c in AXES]).dropna(subset=[*AXES, "g"])
    kind = dict(asked.dtypes)[by] if by else None
    extra = [F.col("g").cast(kind).alias(by)] if by else []
    most = own.agg(F.max("k")).first()[0] or 1
    # of points on one place only the first k ids can be neighbours; queries on one place are asked once
    given = given.withColumn("r", F.expr("row_number() OVER (PARTITION BY g, x, y, z ORDER BY id)")).filter(F.col("r") <= most).drop("r")
    at, tops, steps, depth = search_tree(given, max(leaf, most))
    found, counts = search(own, tops, steps, depth, lambda boxes: boxes.join(at, ["g", "path"]), radius, eps)
    if count_leaves:
        found, extra = found.join(counts, QUERY), [*extra, "leaves"]
    return own.join(found, QUERY).filter("rank <= k").select("qid", "nid", "d2", "rank", *AXES, *extra)


QUERY = ["g", "qx", "qy", "qz"]


def search(own: DataFrame, tops: DataFrame, steps: DataFrame, depth: int, read_leaves: Callable[[DataFrame], DataFrame], radius: float | None = None, eps: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(g, qx, qy, qz, nid, x, y, z, d2, rank) for the places of ``own`` (g, qx, qy, qz, k), and (g, qx, qy, qz, leaves read).

    ``tops``, ``steps``, ``depth``: as by ``search_tree``; a group may have several trees, whose paths differ. ``read_leaves`` adds id, x, y
    and z of a leaf's points to boxes with ``path``. Where boxes are single places at one distance, those of
    larger ids than k points have are left, too.
    """
    per_query = f"PARTITION BY {', '.join(QUERY)}"
    per_spot = f"PARTITION BY spot, {', '.join(QUERY)}"
    asked = own.agg(F.max("k").alias("most"), F.count(F.lit(1)).alias("n")).first()
    most = asked.most or 1

    def bounded(rows: DataFrame) -> DataFrame:
        """Boxes that may hold neighbours: those that begin within what holds k points."""
        rows = rows.withColumn("last", F.expr("CASE WHEN near = far THEN idmax ELSE 9223372036854775807 END"))
        held = rows.withColumn("held", F.expr(f"sum(n) OVER ({per_spot} ORDER BY far, last)"))
        held = held if radius is None else held.filter(F.col("near") <= radius * radius * SLACK)
        held = held.withColumn("bound", F.expr(f"min(CASE WHEN held >= k THEN struct(far, last) END) OVER ({per_spot})"))
        open_ = F.expr(f"bound IS NULL OR near <= bound.far * {SLACK} AND NOT (near = far AND near = bound.far AND idmin > bound.last)")
        return held.filter(open_).drop("held", "bound", "last")

    # a number of partitions, as small rows would be put together; by a hash, which is no float and so is the same key to all windows
    places = own.groupBy(*QUERY).agg(F.max("k").alias("k")).withColumn("spot", F.xxhash64(*QUERY))
    places = places.repartition(-(-asked.n // QUERIES) or 1, "spot")
    known = ["path", "n", "idmin", "idmax"]
    columns = [*QUERY, "spot", "k", *known, "near", "far"]
    front = bounded(places.join(lookup(tops), "g").withColumns({"near": _nearest("q", ""), "far": _farthest("q", "")}).select(columns))
    below = lookup(steps.select("g", F.col("up").alias("path"), F.struct(*known).alias("child"), *_box("")))
    for _ in range(depth):
        # a leaf has nothing below and stays
        down = front.join(below, ["g", "path"], "left")
        stays = F.col("child").isNull()
        new = {**{c: F.col(f"child.{c}") for c in known}, "near": _nearest("q", ""), "far": _farthest("q", "")}
        front = bounded(down.select(*QUERY, "spot", "k", *[F.when(stays, F.col(c)).otherwise(v).alias(c) for c, v in new.items()]))
    front = materialize(front.select(*QUERY, "k", "path", "n", "near"), "boxes")
    first = front.withColumn("before", F.expr(f"sum(n) OVER ({per_query} ORDER BY near, path) - n")).withColumn("early", F.col("before") < F.col("k"))
    columns = [*QUERY, "k", "id", *AXES, "d2"]

    def read(boxes: DataFrame, within: str = "true") -> DataFrame:
        pairs = read_leaves(boxes.drop("n")).withColumn("d2", F.expr("(qx-x)*(qx-x)+(qy-y)*(qy-y)+(qz-z)*(qz-z)")).filter(within)
        return (pairs if radius is None else pairs.filter(F.col("d2") < radius * radius)).select(columns)

    def nearest(pairs: DataFrame) -> DataFrame:
        """The limit that is the same for all queries is applied before rows are moved."""
        ranked = pairs.withColumn("rank", F.expr(f"row_number() OVER ({per_query} ORDER BY d2, id)"))
        return ranked.filter(F.col("rank") <= most).filter("rank <= k")

    early = materialize(nearest(read(first.filter("early"))), "early")
    # with fewer than k points so far nothing is out of reach
    bound = early.groupBy(*QUERY).agg(F.max(F.when(F.col("rank") == F.col("k"), F.col("d2"))).alias("far"))
    left = first.filter("NOT early").join(bound, QUERY, "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    left = left.filter(F.col("near") * (1 + eps) ** 2 <= F.col("far") * SLACK)
    later = read(left, "d2 <= far")
    found = nearest(early.drop("rank").unionByName(later))
    counts = first.filter("early").select(QUERY).unionByName(left.select(QUERY)).groupBy(*QUERY).agg(F.count(F.lit(1)).alias("leaves"))
    return materialize(found.drop("k"), "found").withColumnRenamed("id", "nid"), counts


def region_distances(points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(ra, rb, h, gap): for each point of ra the least distance to rb; the largest (directed Hausdorff) and the least of
    these. points: id, x, y, z, region.

    Branch and bound over pairs of boxes, one of each region. A box of ra is at least as far from rb as the nearest of its
    partners begins, and at most as far as the nearest of them ends. Boxes whose points can't be the farthest of their region are left, and so are
    partners that begin beyond where another one ends; for the gap, all pairs that begin beyond where some pair ends.
    What remains of both trees' leaves is compared point by point.
    """
    given = points.select(F.col("region").cast("string").alias("g"), "id", *[F.col(c).cast("double") for c in AXES], "region").dropna()
    at, tops, steps, depth = search_tree(given, leaf)
    # each region with each other: as many rows as the result has
    roots = tops.agg(F.collect_list(F.struct("g", "path", *_box(""))).alias("all"))
    one = roots.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter("a.g <> b.g")
    names = ["g", "path", *_box("")]
    pairs = one.select(*[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in names])

    def bounded(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"near": _nearest("a_", "b_"), "far": _farthest("a_", "b_")})
        box = "PARTITION BY a_g, b_g, a_path"
        both = "PARTITION BY a_g, b_g"
        rows = rows.withColumns({"least": F.expr(f"min(near) OVER ({box})"), "most": F.expr(f"min(far) OVER ({box})")})
        rows = rows.withColumns({"low": F.expr(f"max(least) OVER ({both})"), "gap": F.expr(f"min(far) OVER ({both})")})
        rows = rows.withColumn("for_h", F.expr(f"h_open AND most * {SLACK} >= low AND near <= most * {SLACK}")).withColumn("for_gap", F.expr(f"near <= gap * {SLACK}"))
        return rows.filter("for_h OR for_gap").withColumn("h_open", F.col("for_h")).drop("near", "far", "least", "most", "low", "gap", "for_h", "for_gap")

    def lower(rows: DataFrame, p: str) -> DataFrame:
        """Pairs with what lies below their box ``p``; a leaf has nothing below and stays."""
        child = steps.select(F.col("g").alias(f"{p}_g"), F.col("up").alias(f"{p}_path"), F.struct("path", *_box("")).alias("child"))
        down = rows.join(lookup(child), [f"{p}_g", f"{p}_path"], "left")
        return down.withColumns({f"{p}_{c}": F.coalesce(F.col(f"child.{c}"), F.col(f"{p}_{c}")) for c in ("path", *_box(""))}).drop("child")

    pairs = bounded(pairs.withColumn("h_open", F.lit(True)))
    for _ in range(depth):
        pairs = materialize(bounded(lower(lower(pairs, "a"), "b")), "pairs")
    places = at.select("g", "path", "id", *AXES)
    left = places.select(F.col("g").alias("a_g"), F.col("path").alias("a_path"), F.col("id").alias("aid"), *[F.col(c).alias(f"a{c}") for c in AXES])
    right = places.select(F.col("g").alias("b_g"), F.col("path").alias("b_path"), *[F.col(c).alias(f"o{c}") for c in AXES])
    met = pairs.select("a_g", "b_g", "a_path", "b_path", "h_open").join(left, ["a_g", "a_path"]).join(right, ["b_g", "b_path"])
    d2 = F.expr("(ax-ox)*(ax-ox)+(ay-oy)*(ay-oy)+(az-oz)*(az-oz)")
    each = met.groupBy("a_g", "b_g", "aid").agg(F.min(d2).alias("d2"), F.min(F.when(F.col("h_open"), d2)).alias("of_h"))
    both = each.groupBy("a_g", "b_g").agg(F.sqrt(F.max("of_h")).alias("h"), F.sqrt(F.min("d2")).alias("gap"))
    kind = dict(points.dtypes)["region"]
    return both.select(F.col("a_g").cast(kind).alias("ra"), F.col("b_g").cast(kind).alias("rb"), "h", "gap")


def hausdorff(points: DataFrame) -> DataFrame:
    """(ra, rb, h) with ra < rb: the larger of both directed distances."""
    d = region_distances(points)
    return d.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), "h").groupBy("ra", "rb").agg(F.max("h").alias("h"))
