"""DXF drawings (R10, ASCII) from a table of entities: ord, layer, kind, color, x1..z2, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = ("points", "ids", "normals", "facilities", "clients", "lines", "boxes")


def _entity(df: DataFrame, layer: str, kind: str, a: tuple, b: tuple, text=None) -> DataFrame:
    ends = [F.expr(str(e)).cast("double").alias(n) for e, n in zip((*a, *b), ("x1", "y1", "z1", "x2", "y2", "z2"), strict=True)]
    label = F.col(text).cast("string") if text else F.lit(None).cast("string")
    return df.select(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), F.lit(LAYERS.index(layer) + 1 if layer in LAYERS else 1).alias("color"), *ends, label.alias("text"))


def cluster_entities(points: DataFrame, assignment: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points, ids and normals (0.1 long), facilities, clients with a line to their facility, box edges."""
    own = points.join(assignment, "id")
    xyz, zero = ("x", "y", "z"), (0, 0, 0)
    centre = points.select(F.col("id").alias("fid"), *[F.col(c).alias(f"f{c}") for c in xyz])
    clients = own.filter("id <> fid").join(centre, "fid")
    corners = [(f"x{a}", f"y{b}", f"z{c}") for a in ("min", "max") for b in ("min", "max") for c in ("min", "max")]
    edges = [(p, q) for i, p in enumerate(corners) for q in corners[i + 1 :] if sum(u != v for u, v in zip(p, q, strict=True)) == 1]
    parts = [
        _entity(own, "points", "POINT", xyz, zero),
        _entity(own, "ids", "TEXT", xyz, zero, "id"),
        _entity(own, "normals", "LINE", xyz, ("x+0.1*na", "y+0.1*nb", "z+0.1*nc")),
        _entity(own.filter("id = fid"), "facilities", "POINT", xyz, zero),
        _entity(clients, "clients", "POINT", xyz, zero),
        _entity(clients, "lines", "LINE", xyz, ("fx", "fy", "fz")),
        *[_entity(boxes, "boxes", "LINE", p, q) for p, q in edges],
    ]
    return reduce(DataFrame.unionByName, parts)


def polyline_entities(points: DataFrame) -> DataFrame:
    """A line from each point to the next of its region, by ord."""
    ahead = points.select("*", *[F.expr(f"lead({c}) OVER (PARTITION BY region_id ORDER BY ord)").alias(f"n{c}") for c in "xyz"]).filter("nx IS NOT NULL")
    return _entity(ahead, "Polyline", "LINE", ("x", "y", "z"), ("nx", "ny", "nz"))


def header() -> str:
    return "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1006\n0\nENDSEC\n"


def tables(layers: tuple[str, ...] = LAYERS) -> str:
    rows = "".join(f"0\nLAYER\n2\n{name}\n70\n0\n62\n{i}\n6\nCONTINUOUS\n" for i, name in enumerate(layers, 1))
    return f"0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n70\n{len(layers)}\n{rows}0\nENDTAB\n0\nENDSEC\n"


def entity_text(entities: DataFrame) -> DataFrame:
    """One value for each entity: its group codes, numbers with 3 decimals."""
    number = lambda c: F.format_string("%.3f", c)
    first = F.concat(F.lit("\n10\n"), number("x1"), F.lit("\n20\n"), number("y1"), F.lit("\n30\n"), number("z1"))
    second = F.concat(F.lit("\n11\n"), number("x2"), F.lit("\n21\n"), number("y2"), F.lit("\n31\n"), number("z2"))
    rest = F.when(F.col("kind") == "LINE", second).when(F.col("kind") == "TEXT", F.concat(F.lit("\n40\n0.010\n1\n"), "text")).otherwise("")
    return entities.select("layer", F.concat(F.lit("0\n"), "kind", F.lit("\n8\n"), "layer", F.lit("\n62\n"), F.col("color").cast("string"), first, rest).alias("value"))


def drawing_lines(entities: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(ord, value) of a drawing for ``sinks.write``: its text files, one after the other, are the drawing, and no task or driver
    holds it whole."""
    order = lambda part, own: F.struct(F.lit(part).alias("part"), own.alias("own"))
    body = entity_text(entities).select(order(1, F.xxhash64("value")).alias("ord"), "value")
    first, last = header() + tables(layers) + "0\nSECTION\n2\nENTITIES", "0\nENDSEC\n0\nEOF"
    ends = [entities.sparkSession.range(1).select(order(part, F.lit(0).cast("long")).alias("ord"), F.lit(text).alias("value")) for part, text in ((0, first), (2, last))]
    return reduce(DataFrame.unionByName, ends, body)
