"""Queries over the driver's tables for each operator, and their SQL for another engine.

The SQL is written from the definitions and shares no expression with the operators: metrics by their formulas, neighbours
by comparing all pairs, eigenvalues by Newton's method, ranks of bins by sorting them. The cloud is made of ``embeddings``: point = elements 1 to 3, plane = 4 to 7, eigenvalues = 8 to 10 by size, region = label.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudspark.functions import metrics as M
from cloudspark.operators import facility, generate, grid, kdtree, planes, regions, stats, tiling
from cloudspark.operators.knn import knn
from cloudspark.operators.neighbour_index import NeighbourIndex
from cloudspark.plans.storage import folder, materialize
from cloudspark.sources import dxf, points as source, sinks
from cloudspark.streaming import point_fold

BIN, RADIUS, REACH, K = 0.1, 0.1, 0.3, 10
EDGE = 0.08
PARAMS = {"lam": 0.1, "mju": 0.95, "power": 1.0}

_E = lambda i: f"cast(element_at(embedding, {i}) as double)"
_CLOUD = {
    "id": "vec_id", "x": _E(1), "y": _E(2), "z": _E(3), "fc": "1.0D", "r": "cast(0 as smallint)", "g": "cast(0 as smallint)", "b": "cast(0 as smallint)",
    "na": _E(4), "nb": _E(5), "nc": _E(6), "nw": _E(7), "region": "cast(label as bigint)", "height": f"abs({_E(11)})",
}
_SIZES = [f"abs({_E(i)})" for i in (8, 9, 10)]
_CLOUD |= {"l1": f"greatest({', '.join(_SIZES)})", "l3": f"least({', '.join(_SIZES)})", "l2": f"({'+'.join(_SIZES)}-greatest({', '.join(_SIZES)})-least({', '.join(_SIZES)}))"}
CLOUD_SQL = "WITH cloud AS (SELECT {} FROM embeddings)".format(
    ", ".join(f"{e.replace('element_at', 'list_extract').replace('1.0D', 'cast(1.0 as double)')} AS {n}" for n, e in _CLOUD.items())
)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(*[F.expr(e).alias(n) for n, e in _CLOUD.items()])


CLOUD_SQL = CLOUD_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def r6(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"{CLOUD_SQL} {sql}"
        return f

    return keep


# sources


@query("SELECT id, x, y, z, fc, r, g, b FROM cloud")
def cloud_scan(spark, sf_dir):
    return cloud(spark, sf_dir).select("id", "x", "y", "z", "fc", "r", "g", "b")


_INTS = {n: f"cast(floor({n}*1000) as bigint)" for n in "xyz"}
_TEXT = {1: "x", 2: "x y", 3: "x y z", 4: "x y z q", 5: "x y z q q", 6: "x y z q q q", 7: "x y z q q q q", 8: "id x y z q q q q", 9: "id x y z q q q q q"}


def _width_lines(spark, sf_dir) -> DataFrame:
    """Text rows of 1 to 9 tokens; q is the id mod 5."""
    c = cloud(spark, sf_dir).select("id", *[F.expr(e).alias(n) for n, e in _INTS.items()], F.expr("id % 5").alias("q"))
    text = F.lit(None).cast("string")
    for width, names in _TEXT.items():
        text = F.when(F.col("id") % 9 + 1 == width, F.concat_ws(" \t ", *names.split())).otherwise(text)
    return c.select(F.col("id").alias("pos"), F.concat(F.lit(" "), text).alias("value"))


def _widths_sql(with_ids: bool) -> str:
    w, q = "(id % 9 + 1)", "cast(id % 5 as double)"
    x, y, z = (f"cast({_INTS[n]} as double)" for n in "xyz")
    if with_ids:  # 4 and 7 columns begin with an id, here the scaled x
        own_id = f"CASE WHEN {w} IN (4, 7) THEN {_INTS['x']} ELSE id END"
        xs, ys, zs = f"CASE WHEN {w} IN (4, 7) THEN {y} ELSE {x} END", f"CASE WHEN {w} IN (4, 7) THEN {z} ELSE {y} END", f"CASE WHEN {w} IN (4, 7) THEN {q} ELSE {z} END"
        fc = f"CASE WHEN {w} = 8 THEN {q} ELSE 1.0 END * 2.0"
    else:
        own_id, xs, ys, zs, fc = "id", x, y, z, f"CASE WHEN {w} IN (4, 7, 8) THEN {q} ELSE 1.0 END * 2.0"
    rgb = f"cast(CASE WHEN {w} >= 6 THEN id % 5 ELSE 0 END as smallint)"
    return f"SELECT {own_id} AS id, {xs} AS x, {ys} AS y, {zs} AS z, cast({fc} as double) AS fc, {rgb} AS r, {rgb} AS g, {rgb} AS b FROM cloud WHERE {w} IN (3, 4, 6, 7, 8)"


@query(_widths_sql(False))
def cloud_parse_widths(spark, sf_dir):
    return source.parse_points(_width_lines(spark, sf_dir), multiplier=2.0, non_uniform=True)


@query(_widths_sql(True))
def cloud_parse_widths_ids(spark, sf_dir):
    return source.parse_points(_width_lines(spark, sf_dir), multiplier=2.0, non_uniform=True, with_ids=True)


@query("SELECT id AS pos, concat(id, ' x', id % 3, ' 1') AS value FROM cloud WHERE id % 4 = 1")
def rejected_rows(spark, sf_dir):
    """Rows of a known width with a token that is no number; those of another width are not rejected but skipped."""
    text = "CASE id % 4 WHEN 0 THEN concat(id, ' 1 2') WHEN 1 THEN concat(id, ' x', id % 3, ' 1') WHEN 2 THEN 'a b' ELSE '' END"
    return source.bad_rows(cloud(spark, sf_dir).select(F.col("id").alias("pos"), F.expr(text).alias("value")))


def _cluster_text(spark, sf_dir) -> DataFrame:
    """Lines of a cluster file: every tenth point is a head, followed by the nine after it."""
    c = cloud(spark, sf_dir).select("id")
    return c.select(F.col("id").alias("pos"), F.expr("CASE WHEN id % 10 = 0 THEN concat(id, ': ignored') WHEN id % 10 = 5 THEN '# note' ELSE concat(id, ' ', id + 1) END").alias("value"))


_MEMBERS_SQL = """, members AS (SELECT cast(floor(id / 10) * 10 as bigint) AS cid, cast(2 * (id % 10) - CASE WHEN id % 10 > 5 THEN 3 ELSE 1 END + k as bigint) AS ord, id + k AS id
  FROM cloud, (SELECT unnest([0, 1]) AS k) WHERE id % 10 NOT IN (0, 5))"""


@query(f"{_MEMBERS_SQL} SELECT * FROM members")
def cluster_file(spark, sf_dir):
    return source.parse_clusters(_cluster_text(spark, sf_dir))


@query("SELECT id AS cid FROM cloud WHERE id % 10 = 0 AND id % 3 <> 1")
def centroid_file(spark, sf_dir):
    lines = cloud(spark, sf_dir).filter("id % 10 = 0").select(F.col("id").alias("pos"), F.expr("CASE WHEN id % 3 = 1 THEN 'x' ELSE concat('x ', id, '.0 y') END").alias("value"))
    return source.parse_centroids(lines, 1)


@query(f"""{_MEMBERS_SQL}, heads AS (SELECT id AS cid FROM cloud WHERE id % 20 = 0)
SELECT r.cid, r.ord, r.id, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM (SELECT cid, cast(0 as bigint) AS ord, cid AS id FROM heads
  UNION ALL SELECT cid, ord, id FROM members WHERE cid IN (SELECT cid FROM heads)) r JOIN cloud ON cloud.id = r.id""")
def export_join(spark, sf_dir):
    c = cloud(spark, sf_dir)
    out = stats.export_clusters(c, cluster_file(spark, sf_dir), c.filter("id % 20 = 0").select(F.col("id").alias("cid")))
    return rounded(out, "x", "y", "z")


# grid


@query("SELECT count(*) AS n, " + ", ".join(f"{k}({c}) AS {c}{k}" for c in "xyz" for k in ("min", "max")) + " FROM cloud")
def bbox(spark, sf_dir):
    return grid.extents(cloud(spark, sf_dir))


_BOX = ", box AS (SELECT " + ", ".join(f"{k}({c}) AS {c}{k}" for c in "xyz" for k in ("min", "max")) + " FROM cloud)"
_COUNTS = ", ".join(f"cast(greatest(1, ceil(({c}max - {c}min) / {BIN})) as bigint) AS n{c}" for c in "xyz")
_PLACE = ", ".join(f"cast(floor((p.{c} - {c}min) / ({c}max - {c}min) * n{c} * 0.99) as bigint) AS i{c}" for c in "xyz")
_INDEXED = f"{_BOX}, counts AS (SELECT *, {_COUNTS} FROM box), indexed AS (SELECT p.id, {_PLACE}, nx, ny FROM cloud p, counts)"


@query(f"{_INDEXED} SELECT id, ix, iy, iz FROM indexed")
def grid_index3d(spark, sf_dir):
    return grid.with_index(cloud(spark, sf_dir), BIN).select("id", "ix", "iy", "iz")


@query(f"{_INDEXED} SELECT id, ix + nx * (iy + ny * iz) AS cell FROM indexed")
def grid_index1d(spark, sf_dir):
    return grid.with_index(cloud(spark, sf_dir), BIN).select("id", "cell")


@query(f"{_INDEXED} SELECT ix + nx * (iy + ny * iz) AS cell, count(*) AS n FROM indexed GROUP BY 1")
def grid_occupancy(spark, sf_dir):
    return grid.with_index(cloud(spark, sf_dir), BIN).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_INDEXED} SELECT a.id, count(*) AS n FROM indexed a JOIN indexed b ON abs(a.ix-b.ix) <= 1 AND abs(a.iy-b.iy) <= 1 AND abs(a.iz-b.iz) <= 1 GROUP BY a.id")
def grid_adjacent27(spark, sf_dir):
    rows = grid.with_index(cloud(spark, sf_dir), BIN).select("id", "ix", "iy", "iz")
    counts = rows.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("m"))
    return rows.join(grid.spread(counts, ("ix", "iy", "iz")), ["ix", "iy", "iz"]).groupBy("id").agg(F.sum("m").alias("n"))


_AXIS_BINS = {"x": 7, "y": 4, "z": 3}
_AT = ", ".join(f"cast(floor({0.99 * n} * (p.{c} - {c}min) / ({c}max - {c}min)) as bigint) AS i{c}" for c, n in _AXIS_BINS.items())


@query(f"{_BOX} SELECT id, ix, iy, iz, ix + 7 * iy + 28 * iz AS cell FROM (SELECT p.id, {_AT} FROM cloud p, box)")
def grid_by_count(spark, sf_dir):
    return grid.with_index_by_count(cloud(spark, sf_dir), *_AXIS_BINS.values()).select("id", "ix", "iy", "iz", "cell")


_MOVED = ", ".join(f"CASE WHEN p.{c} + 0.25 > {c}max THEN -1 ELSE cast(floor((p.{c} + 0.25 - {c}min) / ({c}max - {c}min) * n{c} * 0.99) as bigint) END AS i{c}" for c in "xyz")


@query(f"{_BOX}, counts AS (SELECT *, {_COUNTS} FROM box) SELECT p.id, {_MOVED} FROM cloud p, counts")
def grid_outside(spark, sf_dir):
    """Points moved by a quarter, of which some leave the grid."""
    c = cloud(spark, sf_dir)
    return grid.locate(c.select("id", *[(F.col(a) + 0.25).alias(a) for a in "xyz"]), c, BIN).select("id", "ix", "iy", "iz")


_LAYERS = ", ".join(f"cast(floor((p.{c} - {c}min) / ({c}max - {c}min) * 4.95) as bigint) AS {n}" for c, n in (("z", "layer"), ("y", "line"), ("x", "col")))


@query(f"""{_BOX}, axis AS (SELECT unnest(range(5)) AS i), walk AS (SELECT a.i AS layer, b.i AS line, c.i AS col,
  row_number() OVER (ORDER BY a.i, CASE WHEN a.i % 2 = 0 THEN b.i ELSE -b.i END, CASE WHEN (a.i + b.i) % 2 = 0 THEN c.i ELSE -c.i END) AS bin FROM axis a, axis b, axis c)
SELECT id, bin FROM (SELECT p.id, {_LAYERS} FROM cloud p, box) JOIN walk USING (layer, line, col)""")
def bin_order(spark, sf_dir):
    return grid.serpentine_bins(cloud(spark, sf_dir), 5).select("id", "bin")


# joins

_PAIR = ", ".join(f"p.{c} AS a{c}, q.{c} AS o{c}" for c in "xyz")
_NEAR = f", near AS (SELECT p.id AS aid, q.id AS oid, sqrt((p.x - q.x)^2 + (p.y - q.y)^2 + (p.z - q.z)^2) AS d FROM cloud p, cloud q)"


@query(f"{_NEAR} SELECT aid AS id, count(*) AS n, {r6('sum(d)')} AS d FROM near WHERE d <= {RADIUS} GROUP BY aid")
def radius_join(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(grid.radius_join(c, c, RADIUS).groupBy(F.col("aid").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")), "d")


_KNN = """, knn AS (SELECT qid, nid, d2, rank FROM (SELECT q.id AS qid, p.id AS nid, (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z) AS d2,
  row_number() OVER (PARTITION BY q.id ORDER BY (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z), p.id) AS rank FROM cloud q, cloud p))"""
_RANKED = f"SELECT qid, nid, {r6('d2')} AS d2, cast(rank as integer) AS rank FROM knn"


@query(f"{_KNN} {_RANKED} WHERE rank <= {K}")
def knn_topk(spark, sf_dir):
    return rounded(knn(cloud(spark, sf_dir), K).select("qid", "nid", "d2", "rank"), "d2")


@query(f"{_KNN} {_RANKED} WHERE rank <= qid % 7 + 1")
def knn_per_query_k(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(knn(c, "k", c.withColumn("k", F.col("id") % 7 + 1)).select("qid", "nid", "d2", "rank"), "d2")


@query(f"{_KNN} {_RANKED} WHERE rank <= {K}")
def knn_tree(spark, sf_dir):
    """The same by a tree of boxes."""
    return rounded(kdtree.knn(cloud(spark, sf_dir), K).select("qid", "nid", "d2", "rank"), "d2")


@query(f"{_KNN} {_RANKED} WHERE rank <= {K} AND d2 < {REACH * REACH}")
def knn_within_radius(spark, sf_dir):
    return rounded(kdtree.knn(cloud(spark, sf_dir), K, radius=REACH).select("qid", "nid", "d2", "rank"), "d2")


@query(f"{_KNN.replace('FROM cloud q, cloud p', 'FROM cloud q, cloud p WHERE p.id % 5 <> 0')} {_RANKED} WHERE rank <= {K}")
def knn_saved_index(spark, sf_dir):
    """All points' neighbours by a saved index that took the cloud in three batches and gave a fifth of it back."""
    c = cloud(spark, sf_dir)
    index = NeighbourIndex.create(spark, folder(spark, "index"))
    for third in range(3):
        index = index.insert(c.filter(F.col("id") % 3 == third))
    index = index.remove(c.filter("id % 5 = 0"))
    return rounded(NeighbourIndex.open(spark, index.path).knn(c, K).select("qid", "nid", "d2", "rank"), "d2")


@query(f"{_KNN} SELECT qid, cast(rank as integer) AS rank, {r6('d2')} AS d2, true AS bounded, true AS no_more FROM knn WHERE rank <= {K}")
def knn_bounded_error(spark, sf_dir):
    """Of each rank the true distance, whether that of the search with an error of 0.5 is within 1.5 times it, and whether that search
    reads no more leaves."""
    c = cloud(spark, sf_dir)
    exact = kdtree.knn(c, K, count_leaves=True).select("qid", "rank", "d2", "leaves")
    near = kdtree.knn(c, K, eps=0.5, count_leaves=True).select("qid", "rank", F.col("d2").alias("found"), F.col("leaves").alias("read"))
    both = exact.join(near, ["qid", "rank"])
    bounded = F.sqrt("found") <= 1.5 * F.sqrt("d2") + 1e-12
    return rounded(both.select("qid", "rank", "d2", bounded.alias("bounded"), (F.col("read") <= F.col("leaves")).alias("no_more")), "d2")


@query(f"{_KNN} SELECT qid AS id, min_by(nid, rank) AS nid, {r6('sqrt(min(d2))')} AS d FROM knn WHERE rank <= 2 AND qid <> nid GROUP BY qid")
def nearest_neighbor(spark, sf_dir):
    two = knn(cloud(spark, sf_dir), 2).filter("qid <> nid").groupBy(F.col("qid").alias("id"))
    return rounded(two.agg(F.min_by("nid", "rank").alias("nid"), F.sqrt(F.min("d2")).alias("d")), "d")


# planes and shapes

_AXES = ("xx", "xy", "xz", "yy", "yz", "zz")
_MOMENTS = "count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, " + ", ".join(f"coalesce(covar_samp({k[0]}, {k[1]}), 0.0) AS {k}" for k in _AXES)


def _eigen(source: str, key: str) -> str:
    """CTE ``eig``: eigenvalues l1 to l3 of the covariances in ``source``, roots of the characteristic polynomial: Newton's
    method runs down to the largest root and up to the least."""
    f, slope = "((({0} - tr) * {0} + c1) * {0} - c0)", "((3 * {0} - 2 * tr) * {0} + c1)"
    step = lambda x: f"CASE WHEN {slope.format(x)} = 0 THEN {x} ELSE {x} - {f.format(x)} / nullif({slope.format(x)}, 0) END"
    return f""", poly AS (SELECT {key}, xx + yy + zz AS tr, xx*yy - xy*xy + xx*zz - xz*xz + yy*zz - yz*yz AS c1,
  xx*yy*zz + 2*xy*yz*xz - xx*yz*yz - yy*xz*xz - zz*xy*xy AS c0 FROM {source}),
newton AS (SELECT {key}, tr, c1, c0, 0 AS k, tr AS high, 0.0::DOUBLE AS low FROM poly
  UNION ALL SELECT {key}, tr, c1, c0, k + 1, {step("high")}, {step("low")} FROM newton WHERE k < 60),
eig AS (SELECT s.*, high AS l1, tr - high - low AS l2, low AS l3 FROM {source} s JOIN newton w ON s.{key} = w.{key} AND w.k = 60)"""


_COV = f", cov AS (SELECT region, {_MOMENTS} FROM cloud GROUP BY region)" + _eigen("cov", "region")
_COV_NAMES = ("mx", "my", "mz", *_AXES)


@query(f"{_COV} SELECT region, n, {', '.join(f'{r6(c)} AS {c}' for c in _COV_NAMES)} FROM cov")
def centroid_cov(spark, sf_dir):
    return rounded(planes.covariance(cloud(spark, sf_dir), "region"), *_COV_NAMES)


@query(f"{_COV} SELECT region, {', '.join(f'{r6(c)} AS {c}' for c in ('l1', 'l2', 'l3'))} FROM eig")
def eigenvalues(spark, sf_dir):
    return rounded(planes.with_eigenvalues(planes.covariance(cloud(spark, sf_dir), "region")), "l1", "l2", "l3").select("region", "l1", "l2", "l3")


_SHAPES = {"linearity": M.linearity(""), "planarity": M.planarity(""), "sphericity": M.sphericity(""), "omnivariance": M.omnivariance(""), "anisotropy": M.anisotropy(""), "curvature": M.curvature(""), "entropy": M.entropy("")}
_SHAPES_SQL = {
    "linearity": "1 - l2/l1", "planarity": "(l2 - l3)/l1", "sphericity": "l3/l1", "omnivariance": "cbrt(l1*l2*l3)", "anisotropy": "1 - l3/l1",
    "curvature": "l3/(l1 + l2 + l3)", "entropy": "-l1*ln(l1) - l2*ln(l2) - l3*ln(l3)",
}


@query(f"{_COV} SELECT region, {', '.join(f'{r6(e)} AS {n}' for n, e in _SHAPES_SQL.items())} FROM eig")
def shape_features(spark, sf_dir):
    out = planes.with_eigenvalues(planes.covariance(cloud(spark, sf_dir), "region"))
    return rounded(out.select("region", *[F.expr(e).alias(n) for n, e in _SHAPES.items()]), *_SHAPES)


_LOCAL = f"{_KNN}, own AS (SELECT qid, {_MOMENTS} FROM knn JOIN cloud ON nid = id WHERE rank <= {K} GROUP BY qid)" + _eigen("own", "qid")


@query(f"{_LOCAL} SELECT qid AS id, {r6('l3/(l1 + l2 + l3)')} AS curv FROM eig WHERE l3/(l1 + l2 + l3) > {EDGE}")
def curvature_edges(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(regions.edge_points(c.select("id"), planes.planes(c, knn(c, K)), EDGE).select("id", "curv"), "curv")


@query(f"{_LOCAL} SELECT qid AS id, {r6('l3/(l1 + l2 + l3)')} AS curv, row_number() OVER (ORDER BY {r6('l3/(l1 + l2 + l3)')} DESC, qid) AS ord FROM eig WHERE l3/(l1 + l2 + l3) > {EDGE}")
def curvature_queue(spark, sf_dir):
    """Edge points by curvature, largest first."""
    c = cloud(spark, sf_dir)
    edges = regions.edge_points(c.select("id"), planes.planes(c, knn(c, K)), EDGE).select("id", "curv")
    edges = materialize(rounded(edges, "curv"), "edges")
    return stats.sort_by(edges, edges, "curv")


@query("SELECT id, region, row_number() OVER (ORDER BY height DESC, id) AS ord FROM cloud")
def sort_by_column(spark, sf_dir):
    """One table by a column of another."""
    c = cloud(spark, sf_dir)
    return stats.sort_by(c.select("id", "region"), c.select("id", "height"), "height")


def _planes(spark, sf_dir) -> DataFrame:
    c = cloud(spark, sf_dir)
    return planes.planes(c, knn(c, K))


@query(f"{_LOCAL} SELECT qid AS id, {', '.join(f'{r6(c)} AS {c}' for c in ('l1', 'l2', 'l3'))}, cast(1.0 as double) AS unit, cast(0.0 as double) AS off, cast(0.0 as double) AS bent FROM eig")
def plane_normal(spark, sf_dir):
    """Eigenvalues; of the normal n its length, how far the plane is from the centroid, and the largest part of C n - l3 n, where
    C is the neighbours' covariance: no other direction than the normal's gives 0."""
    c = cloud(spark, sf_dir)
    near = materialize(knn(c, K), "knn")
    rows = planes.planes(c, near).join(planes.covariance(planes.neighbourhoods(c, near), "qid"), "qid")
    turned = [f"abs({a}*na+{b}*nb+{d}*nc-l3*n{n})" for a, b, d, n in (("xx", "xy", "xz", "a"), ("xy", "yy", "yz", "b"), ("xz", "yz", "zz", "c"))]
    off = {"unit": "sqrt(na*na+nb*nb+nc*nc)", "off": "abs(mx*na+my*nb+mz*nc+nw)", "bent": f"greatest({', '.join(turned)})"}
    return rounded(rows.select(F.col("qid").alias("id"), "l1", "l2", "l3", *[F.expr(e).alias(n) for n, e in off.items()]), "l1", "l2", "l3", *off)


def _axis(value: str, name: str) -> str:
    """Unit eigenvector of an eigenvalue: the longest cross product of two rows of C - value I."""
    rows = (f"(xx-{value})", "xy", "xz"), ("xy", f"(yy-{value})", "yz"), ("xz", "yz", f"(zz-{value})")
    cross = lambda u, v: [f"{u[(i + 1) % 3]}*{v[(i + 2) % 3]} - {u[(i + 2) % 3]}*{v[(i + 1) % 3]}" for i in range(3)]
    found = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    listed = ", ".join(f"{{'s': ({a})^2 + ({b})^2 + ({c})^2, 'x': {a}, 'y': {b}, 'z': {c}}}" for a, b, c in found)
    return f"list_max([{listed}]) AS {name}"


_AXES_SQL = f""", two AS (SELECT qid, {_axis("l3", "n")}, {_axis("l1", "t")} FROM eig),
three AS (SELECT qid, n, t, {{'s': n.s * t.s, 'x': n.y*t.z - n.z*t.y, 'y': n.z*t.x - n.x*t.z, 'z': n.x*t.y - n.y*t.x}} AS w FROM two),
along AS (SELECT knn.qid, {", ".join(f"(x*{a}.x + y*{a}.y + z*{a}.z)/sqrt({a}.s) AS {a}" for a in "ntw")} FROM knn JOIN cloud ON nid = id JOIN three ON three.qid = knn.qid WHERE rank <= {K})"""


@query(f"{_LOCAL}{_AXES_SQL} SELECT qid AS id, {r6('least(max(n) - min(n), max(t) - min(t), max(w) - min(w))')} AS height FROM along GROUP BY qid")
def pca_height(spark, sf_dir):
    return rounded(_planes(spark, sf_dir).select(F.col("qid").alias("id"), "height"), "height")


@query(f"{_LOCAL} SELECT qid AS id, {r6('sqrt(9 * l3)')} AS sigma, {r6('sqrt(l3)/(sqrt(l1) + sqrt(l2) + sqrt(l3))')} AS var FROM eig")
def svd_plane(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(planes.svd_planes(c, materialize(knn(c, K), "knn")).select(F.col("qid").alias("id"), "sigma", "var"), "sigma", "var")


_SINE = "sqrt(greatest(0, (1 - abs(p.na*q.na + p.nb*q.nb + p.nc*q.nc) / (sqrt(p.na^2 + p.nb^2 + p.nc^2) * sqrt(q.na^2 + q.nb^2 + q.nc^2))) / 2))"


@query(f"{_KNN} SELECT qid AS id, {r6(f'max(sqrt(d2) * {_SINE})')} AS spread FROM knn JOIN cloud p ON p.id = qid JOIN cloud q ON q.id = nid WHERE rank <= {K} GROUP BY qid")
def angle_spread(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(planes.angle_spread(c.withColumnRenamed("id", "qid"), knn(c, K)), "spread")


@query(f"SELECT id, {r6('least((0.01 / (height + 0.0001))^2, 10000)')} AS fc FROM cloud")
def cost_recompute(spark, sf_dir):
    return rounded(cloud(spark, sf_dir).select("id", F.expr(planes.recomputed_cost("(fc*0.01)", "height")).alias("fc")), "fc")


@query(f"SELECT id, {r6('CASE WHEN 0.25 / (height + 0.0001) < 0.05 THEN 0.05 WHEN 0.25 / (height + 0.0001) > 5 THEN 5 ELSE 0.25 / (height + 0.0001) END')} AS fc FROM cloud")
def cost_bounded(spark, sf_dir):
    return rounded(cloud(spark, sf_dir).select("id", F.expr(planes.bounded_cost("(fc*0.5)", "height")).alias("fc")), "fc")


# metrics: each point and the next by id


def _metric(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cloud(spark, sf_dir)
    pairs = stats.prefixed(c, "a").join(stats.prefixed(c, "o"), F.col("aid") + 1 == F.col("oid"))
    return rounded(pairs.select(F.col("aid").alias("id"), F.expr(M.metric(name, **PARAMS)).alias("d")), "d")


_BOTH = ", ".join(f"p.{c} AS a{c}, q.{c} AS o{c}" for c in stats.GEOMETRY)
# distance, lengths of both normals, and what the formulas take from them
_MEASURED = """SELECT *, sqrt((ax - ox)^2 + (ay - oy)^2 + (az - oz)^2) AS dist, sqrt(ana^2 + anb^2 + anc^2) AS alen, sqrt(ona^2 + onb^2 + onc^2) AS olen FROM"""
_ABN = "acos(least(1, abs(ana*ona + anb*onb + anc*onc) / (alen * olen)))"
_DFP = "sqrt(((ax*ona + ay*onb + az*onc + onw) / olen)^2 + ((ox*ana + oy*anb + oz*anc + anw) / alen)^2)"
_LOGS = "ln(acos(anc / alen)) + ln(acos(onc / olen))"
_KERNELS = {
    "abn": _ABN,
    "dis": f"sin({_ABN} / 2) * dist",
    "ablp": "asin(least(1, abs((ox-ax)*ana + (oy-ay)*anb + (oz-az)*anc) / (dist * alen))) + asin(least(1, abs((ox-ax)*ona + (oy-ay)*onb + (oz-az)*onc) / (dist * olen)))",
    "dfp": _DFP,
    "lin": "abs((al1 - al2) / al1 - (ol1 - ol2) / ol1)",
    "pla": "((al2 - al3) / al1 + (ol2 - ol3) / ol1) / 2",
    "sph": "abs(al3 / al1 - ol3 / ol1)",
    "omn": "abs(cbrt(al1 * al2 * al3) - cbrt(ol1 * ol2 * ol3))",
    "ani": "abs((al1 - al3) / al1 - (ol1 - ol3) / ol1)",
    "cur": "abs(al3 / (al1 + al2 + al3) - ol3 / (ol1 + ol2 + ol3))",
    "ent": "abs(al1*ln(al1) + al2*ln(al2) + al3*ln(al3) - ol1*ln(ol1) - ol2*ln(ol2) - ol3*ln(ol3))",
    "ver": f"abs({_LOGS}) / 2",
    "hor": f"({_LOGS}) / 2",
}
_PLAIN = {
    "l1": "abs(ax - ox) + abs(ay - oy) + abs(az - oz)",
    "l2": "dist",
    "l22": "(ax - ox)^2 + (ay - oy)^2 + (az - oz)^2",
    "ell": "sqrt((ax - ox)^2 + (ay - oy)^2)",  # the third axis is left out, as by the original
    "geo": "CASE WHEN dist < 0.1 THEN 0 ELSE dist - 0.1 END",
}


def _hybrid(kernel: str) -> str:
    """With mju 0.95, lambda 0.1 and power 1."""
    return f"CASE WHEN dist < 1e-37 THEN 0 ELSE 0.95 * ({kernel}) + 0.05 * dist + CASE WHEN dist >= 0.1 THEN 0.95 * (dist - 0.1) ELSE 0 END END"


_METRICS_SQL = _PLAIN | {k: _hybrid(e) for k, e in _KERNELS.items()}
for _name in M.NAMES:
    _key = f"dist_{_name}" if _name in M.DISTANCES else f"pm_{_name}"
    QUERIES[_key] = partial(_metric, _name)
    SQL[_key] = f"{CLOUD_SQL}, pairs AS ({_MEASURED} (SELECT p.id AS id, {_BOTH} FROM cloud p JOIN cloud q ON p.id + 1 = q.id)) SELECT id, {r6(f'cast({_METRICS_SQL[_name]} as double)')} AS d FROM pairs"


@query(f", pairs AS ({_MEASURED} (SELECT p.id AS id, {_BOTH} FROM cloud p JOIN cloud q ON p.id + 1 = q.id)) SELECT id, {r6('greatest(abs(ax - ox), abs(ay - oy), abs(az - oz)) ^ 2')} AS d FROM pairs")
def metric_of_ones_own(spark, sf_dir):
    """The largest difference of an axis, to the power given, as a function in place of a name."""
    own = lambda a, b, lam, mju, power: f"power(greatest({', '.join(f'abs({a}{c}-{b}{c})' for c in 'xyz')}), {power})"
    c = cloud(spark, sf_dir)
    pairs = stats.prefixed(c, "a").join(stats.prefixed(c, "o"), F.col("aid") + 1 == F.col("oid"))
    return rounded(pairs.select(F.col("aid").alias("id"), F.expr(M.metric(own, power=2.0)).alias("d")), "d")


# facilities: every tenth point; clients go to the nearest in reach


def _assigned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = cloud(spark, sf_dir)
    return c, materialize(stats.nearest_facility(c, c.filter("id % 10 = 0"), REACH), "assigned").select("id", "fid", "d")


_ASSIGNED = f"""{_NEAR}, assigned AS (SELECT id, fid, d FROM (SELECT aid AS id, oid AS fid, d, row_number() OVER (PARTITION BY aid ORDER BY d, oid) AS k FROM near
  WHERE oid % 10 = 0 AND d <= {REACH}) WHERE k = 1), links AS (SELECT fid, s.id AS oid, {_BOTH} FROM assigned s JOIN cloud p ON p.id = fid JOIN cloud q ON q.id = s.id WHERE s.id <> fid), measured AS ({_MEASURED} links)"""


@query(f"{_ASSIGNED} SELECT id, fid, {r6('d')} AS d FROM assigned")
def seeded_assignment(spark, sf_dir):
    return rounded(_assigned(spark, sf_dir)[1], "d")


@query(f"{_ASSIGNED} SELECT {r6('(SELECT count(*) FROM assigned WHERE id = fid) + (SELECT sum(' + _hybrid(_DFP) + ') FROM measured)')} AS total_cost")
def total_cost(spark, sf_dir):
    return rounded(stats.total_cost(*_assigned(spark, sf_dir), "dfp", **PARAMS), "total_cost")


_CLIENT_COV = ", ".join(f"coalesce(covar_samp(o{k[0]}, o{k[1]}), 0.0) AS {k}" for k in _AXES)
_SUMS = f", sums AS (SELECT fid, count(*) AS nc, max(dist) AS rad, avg({_hybrid(_ABN)}) AS abn, avg({_hybrid(_DFP)}) AS dfp, {_CLIENT_COV} FROM measured GROUP BY fid)" + _eigen("sums", "fid")
_SHARES = "CASE WHEN {n} THEN 0 WHEN l1 < 0.01 * (l1 + l2 + l3) THEN 0 WHEN l2 < 0.01 * (l1 + l2 + l3) THEN 1 WHEN l3 < 0.01 * (l1 + l2 + l3) THEN 2 ELSE 3 END"


_STATS = f"""SELECT s.id AS fid, coalesce(nc, 0) AS nc, {r6('coalesce(rad, 0.0)')} AS rad, {r6('coalesce(abn, 0.0)')} AS abn, {r6('coalesce(dfp, 0.0)')} AS dfp,
  {r6('CASE WHEN coalesce(nc, 0) < 2 THEN 1.0 ELSE l2/l1 END')} AS asp, cast({_SHARES.format(n='coalesce(nc, 0) < 2')} as integer) AS dim,
  {r6('acos(c.nc_ / sqrt(c.na^2 + c.nb^2 + c.nc_^2)) * 180 / pi()')} AS slo
FROM assigned s JOIN (SELECT id, na, nb, nc AS nc_ FROM cloud) c ON c.id = s.id LEFT JOIN eig ON eig.fid = s.id WHERE s.id = s.fid"""


@query(f"{_ASSIGNED}{_SUMS} {_STATS}")
def cluster_stats(spark, sf_dir):
    return rounded(stats.cluster_stats(*_assigned(spark, sf_dir), **PARAMS), "rad", "abn", "dfp", "asp", "slo")


@query(f"""{_ASSIGNED}{_SUMS}
SELECT s.id AS fid, {r6('CASE WHEN nc IS NULL OR nc < 2 THEN -1.0 ELSE l2/l1 END')} AS asp, cast({_SHARES.format(n='coalesce(nc, 0) < 2')} as integer) AS dim
FROM assigned s LEFT JOIN eig ON eig.fid = s.id WHERE s.id = s.fid""")
def scatter_stats(spark, sf_dir):
    return rounded(stats.scatter_stats(*_assigned(spark, sf_dir)), "asp")


_OVER = """SELECT s.id AS fid, (SELECT count(*) FROM near n JOIN assigned c ON c.id = n.aid JOIN (SELECT fid, max(dist) AS rad FROM measured GROUP BY fid) r ON r.fid = n.oid
  WHERE n.oid = s.id AND c.id <> c.fid AND c.fid <> s.id AND n.d < r.rad) AS "over" FROM assigned s WHERE s.id = s.fid"""


@query(f"{_ASSIGNED} {_OVER}")
def overlap_count(spark, sf_dir):
    c, a = _assigned(spark, sf_dir)
    return stats.overlap(c, a.select("id", "fid"), REACH)


@query(f"{_ASSIGNED} {_OVER}")
def overlap_of_all(spark, sf_dir):
    c, a = _assigned(spark, sf_dir)
    return stats.overlap_all(c, a.select("id", "fid"))


@query(f"{_ASSIGNED} SELECT fid, count(*) AS n, {', '.join(f'{k}({c}) AS {c}{k}' for c in 'xyz' for k in ('min', 'max'))} FROM assigned JOIN cloud USING (id) GROUP BY fid HAVING count(*) > 1")
def cluster_mbb(spark, sf_dir):
    return stats.bounding_boxes(*_assigned(spark, sf_dir))


@query(f"{_ASSIGNED} SELECT id AS ord, cast(fid as varchar) AS value FROM assigned")
def client_facility_map(spark, sf_dir):
    return sinks.map_lines(_assigned(spark, sf_dir)[1])


_E8 = ", ".join(f"(round(w.{c}, 8) + 0.0) AS {c}" for c in "xyz")
_P8 = "'  ', printf('%.8f', x), '  ', printf('%.8f', y), '  ', printf('%.8f', z), '  ', '1.00000000', '  ', '0  0  0'"


@query(f"SELECT id AS ord, concat(id, {_P8}) AS value FROM cloud")
def point_text(spark, sf_dir):
    return sinks.point_lines(cloud(spark, sf_dir))


@query(f"{_ASSIGNED} SELECT c.id AS ord, concat(c.id, {_P8}) AS value FROM cloud c JOIN assigned s ON c.id = s.id AND s.id = s.fid")
def facility_text(spark, sf_dir):
    c, a = _assigned(spark, sf_dir)
    return sinks.facility_lines(c.join(a.filter("id = fid").select("id"), "id"))


@query(f"""{_ASSIGNED}{_SUMS}, counted AS ({_OVER}) SELECT c.id AS ord, concat(c.id, {_P8}, '  ', coalesce(eig.nc, 0), '  ', printf('%.8f', coalesce(rad, 0.0)), '  ', o."over", '  ',
  printf('%.6f', round(acos(c.nc / sqrt(c.na^2 + c.nb^2 + c.nc^2)) * 180 / pi(), 6))) AS value FROM cloud c JOIN counted o ON o.fid = c.id LEFT JOIN eig ON eig.fid = c.id""")
def statistics_text(spark, sf_dir):
    """Facilities with NC, RAD, OVER and SLO of their statistics."""
    c, a = _assigned(spark, sf_dir)
    a = a.select("id", "fid")
    rows = c.drop("nc").join(rounded(stats.cluster_stats(c, a, **PARAMS), "slo").withColumnRenamed("fid", "id"), "id").join(stats.overlap(c, a, REACH).withColumnRenamed("fid", "id"), "id")
    keep = F.expr("filter(split(value, '  '), (x, i) -> i < 10 OR i IN (14, 15))")
    whole = sinks.statistics_lines(rows)
    return whole.select("ord", F.array_join(keep, "  ").alias("value"))


_FIELDS = {"nc": "long", "rad": "double", "abn": "double", "dfp": "double", "asp": "double", "dim": "int", "over": "long", "slo": "double"}


@query(f"""{_ASSIGNED}{_SUMS}, counted AS ({_OVER}), measures AS ({_STATS}) SELECT w.id, {_E8}, w.fc, w.r, w.g, w.b, {', '.join(f'm.{n}' if n != 'over' else 'o."over"' for n in _FIELDS)}
FROM cloud w JOIN counted o ON o.fid = w.id JOIN measures m ON m.fid = w.id""")
def statistics_fields(spark, sf_dir):
    """All sixteen fields of the lines of statistics, as read back from their text."""
    c, a = _assigned(spark, sf_dir)
    a = a.select("id", "fid")
    shape = rounded(stats.cluster_stats(c, a, **PARAMS), "rad", "abn", "dfp", "asp", "slo").withColumnRenamed("fid", "id")
    lines = sinks.statistics_lines(c.drop("nc").join(shape, "id").join(stats.overlap(c, a, REACH).withColumnRenamed("fid", "id"), "id"))
    kinds = {"id": "long", "x": "double", "y": "double", "z": "double", "fc": "double", "r": "short", "g": "short", "b": "short", **_FIELDS}
    fields = F.split("value", "  ")
    return lines.select(*[(fields[i].cast(t) + F.lit(0.0) if t == "double" else fields[i].cast(t)).alias(n) for i, (n, t) in enumerate(kinds.items())])


@query(f"""{_ASSIGNED}, xyz AS (SELECT p.*, concat(chr(10), '10', chr(10), printf('%.3f', x), chr(10), '20', chr(10), printf('%.3f', y), chr(10), '30', chr(10), printf('%.3f', z)) AS spot FROM cloud p)
SELECT 'facilities' AS layer, concat('0', chr(10), 'POINT', chr(10), '8', chr(10), 'facilities', chr(10), '62', chr(10), '4', spot) AS value FROM xyz JOIN assigned USING (id) WHERE id = fid
UNION ALL SELECT 'ids', concat('0', chr(10), 'TEXT', chr(10), '8', chr(10), 'ids', chr(10), '62', chr(10), '2', spot, chr(10), '40', chr(10), '0.010', chr(10), '1', chr(10), id) FROM xyz JOIN assigned USING (id)
UNION ALL SELECT 'lines', concat('0', chr(10), 'LINE', chr(10), '8', chr(10), 'lines', chr(10), '62', chr(10), '6', c.spot, replace(replace(replace(f.spot, chr(10) || '10' || chr(10), chr(10) || '11' || chr(10)), chr(10) || '20' || chr(10), chr(10) || '21' || chr(10)), chr(10) || '30' || chr(10), chr(10) || '31' || chr(10)))
  FROM assigned s JOIN xyz c ON c.id = s.id JOIN xyz f ON f.id = s.fid WHERE s.id <> s.fid""")
def dxf_text(spark, sf_dir):
    """Group codes of points, texts and lines."""
    c, a = _assigned(spark, sf_dir)
    drawn = dxf.cluster_entities(c, a.select("id", "fid"), stats.bounding_boxes(c, a))
    return dxf.entity_text(drawn.filter("layer IN ('facilities', 'ids', 'lines')"))


_SIX = ("x1", "y1", "z1", "x2", "y2", "z2")
_AT = ", ".join(f"{r6(c)} AS {c}" for c in _SIX)
_BOXES = ", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in "xyz")
_CORNER = ", ".join(f"CASE {b} WHEN 0 THEN {c}0 ELSE {c}1 END AS {c}" for b, c in zip("uvw", "xyz", strict=True))


@query(f"""{_ASSIGNED}, own AS (SELECT c.*, fid FROM cloud c JOIN assigned USING (id)),
box AS (SELECT fid, {_BOXES} FROM own GROUP BY fid HAVING count(*) > 1),
corner AS (SELECT fid, u.u, v.v, w.w, {_CORNER} FROM box, range(2) u(u), range(2) v(v), range(2) w(w)),
drawn AS (SELECT 'points' AS layer, 'POINT' AS kind, 1 AS color, x AS x1, y AS y1, z AS z1, 0 AS x2, 0 AS y2, 0 AS z2, cast(NULL AS varchar) AS text FROM own
UNION ALL SELECT 'ids', 'TEXT', 2, x, y, z, 0, 0, 0, cast(id AS varchar) FROM own
UNION ALL SELECT 'normals', 'LINE', 3, x, y, z, x + na / 10, y + nb / 10, z + nc / 10, NULL FROM own
UNION ALL SELECT 'facilities', 'POINT', 4, x, y, z, 0, 0, 0, NULL FROM own WHERE id = fid
UNION ALL SELECT 'clients', 'POINT', 5, x, y, z, 0, 0, 0, NULL FROM own WHERE id <> fid
UNION ALL SELECT 'lines', 'LINE', 6, o.x, o.y, o.z, f.x, f.y, f.z, NULL FROM own o JOIN cloud f ON f.id = o.fid WHERE o.id <> o.fid
UNION ALL SELECT 'boxes', 'LINE', 7, p.x, p.y, p.z, q.x, q.y, q.z, NULL FROM corner p JOIN corner q ON p.fid = q.fid
  AND q.u >= p.u AND q.v >= p.v AND q.w >= p.w AND (q.u - p.u) + (q.v - p.v) + (q.w - p.w) = 1)
SELECT layer, kind, cast(color AS integer) AS color, {_AT}, text FROM drawn""")
def dxf_layers(spark, sf_dir):
    """All entities of all seven layers."""
    c, a = _assigned(spark, sf_dir)
    return rounded(dxf.cluster_entities(c, a.select("id", "fid"), stats.bounding_boxes(c, a)), *_SIX)


@query(f"{_ASSIGNED} SELECT fid AS ord, concat(fid, ':', chr(10), coalesce(string_agg(cast(id as varchar), ' ' ORDER BY id) FILTER (id <> fid), ''), chr(10)) AS value FROM assigned GROUP BY fid")
def facility_lists(spark, sf_dir):
    return sinks.id_lines(stats.facility_lists(_assigned(spark, sf_dir)[1]))


@query(f"""{_ASSIGNED}, n AS (SELECT count(*) AS n, count(*) FILTER (id = fid) AS f FROM assigned), p AS (SELECT count(DISTINCT fid) AS p FROM assigned WHERE id <> fid)
SELECT kind, sum(c) AS n FROM (SELECT 'POINT' AS kind, 2*n AS c FROM n UNION ALL SELECT 'TEXT', n FROM n UNION ALL SELECT 'LINE', n + (n - f) + 12*p FROM n, p) GROUP BY kind""".replace("sum(c)", "cast(sum(c) as bigint)"))
def dxf_entity_counts(spark, sf_dir):
    c, a = _assigned(spark, sf_dir)
    return dxf.cluster_entities(c, a.select("id", "fid"), stats.bounding_boxes(c, a)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {', '.join(f'{r6(c)} AS {c}' for c in ('x1', 'y1', 'z1', 'x2', 'y2', 'z2'))} FROM (SELECT x AS x1, y AS y1, z AS z1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM cloud WINDOW w AS (PARTITION BY region ORDER BY id)) WHERE x2 IS NOT NULL")
def dxf_polyline(spark, sf_dir):
    rows = cloud(spark, sf_dir).select(F.col("region").alias("region_id"), F.col("id").alias("ord"), "x", "y", "z")
    names = ("x1", "y1", "z1", "x2", "y2", "z2")
    return rounded(dxf.polyline_entities(rows).select(*names), *names)


# regions: points of a label



_RDIST = """, rd AS (SELECT p.region AS ra, q.region AS rb, p.id AS aid, min(sqrt((p.x - q.x)^2 + (p.y - q.y)^2 + (p.z - q.z)^2)) AS d
  FROM cloud p JOIN cloud q ON p.region <> q.region GROUP BY ALL), h AS (SELECT ra, rb, max(d) AS h, min(d) AS gap FROM rd GROUP BY ra, rb)"""


@query(f"{_RDIST} SELECT least(ra, rb) AS ra, greatest(ra, rb) AS rb, {r6('max(h)')} AS h FROM h GROUP BY 1, 2")
def hausdorff(spark, sf_dir):
    return rounded(kdtree.hausdorff(cloud(spark, sf_dir)), "h")


@query(f"{_RDIST} SELECT ra, rb, {r6('gap')} AS gap FROM h")
def min_region_dist(spark, sf_dir):
    return rounded(kdtree.region_distances(cloud(spark, sf_dir)).select("ra", "rb", "gap"), "gap")


@query(f"SELECT p.id, (p.region + 1) % 10 AS region, {r6('min(sqrt((p.x - q.x)^2 + (p.y - q.y)^2 + (p.z - q.z)^2))')} AS d FROM cloud p JOIN cloud q ON q.region = (p.region + 1) % 10 GROUP BY 1, 2")
def point_region_dist(spark, sf_dir):
    """Each point and the region after its own."""
    c = cloud(spark, sf_dir)
    return rounded(stats.point_region_distances(c.withColumn("region", (F.col("region") + 1) % 10), c), "d")


# features of a region or point, made of the plane's columns: curvature, tangent, normal
_FEATURES = {"curv": "height", "tx": "x", "ty": "y", "tz": "z", "nx": "na", "ny": "nb", "nz": "nc"}
_TWO = ", ".join(f"p.{c} AS one_{n}, q.{c} AS two_{n}" for n, c in _FEATURES.items())
_TWO = f", both_ AS (SELECT p.id, {_TWO} FROM cloud p JOIN cloud q ON p.id + 1 = q.id)"
_LENGTH = lambda v: f"sqrt({v}x^2 + {v}y^2 + {v}z^2)"
_ANGLE = lambda v: f"acos(least(1, abs(one_{v}x*two_{v}x + one_{v}y*two_{v}y + one_{v}z*two_{v}z) / ({_LENGTH('one_' + v)} * {_LENGTH('two_' + v)})))"
_BENT = "abs(one_curv - two_curv)"


def _feature_pairs(spark, sf_dir) -> DataFrame:
    c = cloud(spark, sf_dir)
    a = c.select("id", *[F.col(x).alias(f"a{n}") for n, x in _FEATURES.items()])
    return a.join(c.select((F.col("id") - 1).alias("id"), *[F.col(x).alias(f"o{n}") for n, x in _FEATURES.items()]), "id")


@query(f"{_TWO} SELECT id, {r6(_BENT)} AS dcurv, {r6(_ANGLE('t'))} AS abt, {r6(_ANGLE('n'))} AS abn FROM both_")
def region_similarity(spark, sf_dir):
    rows = _feature_pairs(spark, sf_dir)
    return rounded(rows.select("id", *[F.expr(e).alias(n) for n, e in regions.similarity().items()]), "dcurv", "abt", "abn")


@query(f"{_TWO} SELECT id, {_ANGLE('t')} < 0.8 AS one, {_ANGLE('t')} < 0.8 AND {_BENT} < 0.05 AS two, {_BENT} < 0.05 AND {_ANGLE('n')} < 0.9 AS edge FROM both_")
def region_predicates(spark, sf_dir):
    """Both rules for points and regions, here with the difference of curvatures as the distance, and that of older revisions."""
    rows = _feature_pairs(spark, sf_dir).withColumn("gap", F.expr("abs(acurv - ocurv)"))
    rules = {"one": regions.same_region(0.8), "two": regions.same_region(0.8, 0.05), "edge": regions.same_edge(0.05, 0.9)}
    return rows.select("id", *[F.expr(e).alias(n) for n, e in rules.items()])


@query(f"SELECT region, {', '.join(f'{r6(f'avg({c})')} AS {c}' for c in ('height', 'na', 'nb', 'nc'))} FROM cloud GROUP BY region")
def region_feature_means(spark, sf_dir):
    out = cloud(spark, sf_dir).groupBy("region").agg(*[F.avg(c).alias(c) for c in ("height", "na", "nb", "nc")])
    return rounded(out, "height", "na", "nb", "nc")


# tiles

_KD = ", t0 AS (SELECT *, cast(1 as bigint) AS tile FROM cloud)" + "".join(
    f", c{d} AS (SELECT tile, quantile_cont({a}, 0.5) AS cut FROM t{d} GROUP BY tile), t{d + 1} AS (SELECT t.* REPLACE (t.tile * 2 + CASE WHEN {a} > cut THEN 1 ELSE 0 END AS tile) FROM t{d} t JOIN c{d} c ON t.tile = c.tile)"
    for d, a in enumerate("xyz")
)


@query(f"{_KD} SELECT id, tile FROM t3")
def kd_tiles(spark, sf_dir):
    return tiling.kd_tiles(cloud(spark, sf_dir), 3).select("id", "tile")


NS = 40
_TIED = ", tied AS (SELECT id, round(x, 1) AS x, round(y, 1) AS y, round(z, 1) AS z FROM cloud)"
_TURN = lambda *axes: "CASE " + " ".join(f"WHEN max({c}) OVER p > min({c}) OVER p THEN {c}" for c in axes) + " ELSE id END"
_BY_COUNT = f"""{_TIED}, grown AS (SELECT '' AS path, * FROM tied
  UNION ALL SELECT path || CASE WHEN v > cut OR (v = cut AND cut = top) THEN '1' ELSE '0' END, id, x, y, z
  FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY path) AS cut, max(v) OVER (PARTITION BY path) AS top
    FROM (SELECT *, count(*) OVER p AS n, cast(CASE len(path) % 3 WHEN 0 THEN {_TURN(*"xyz")} WHEN 1 THEN {_TURN(*"yzx")} ELSE {_TURN(*"zxy")} END AS double) AS v
      FROM grown WINDOW p AS (PARTITION BY path)) WHERE n > {NS})),
counted AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM grown),
inner_ AS (SELECT path, row_number() OVER (ORDER BY translate(path, '01', '10')) AS split FROM (SELECT DISTINCT path FROM counted WHERE n > {NS})),
tile AS (SELECT path, row_number() OVER (ORDER BY translate(path, '01', '10')) - 1 AS tile_ord FROM (SELECT DISTINCT path FROM counted WHERE n <= {NS}))
SELECT c.id, concat('tile_', coalesce(2 * split - 1 + try_cast(right(c.path, 1) AS bigint), 0), '_', len(c.path), '_', len(c.path) % 3) AS tile_id, cast(tile_ord AS bigint) AS tile_ord
FROM counted c JOIN tile USING (path) LEFT JOIN inner_ i ON i.path = left(c.path, greatest(len(c.path) - 1, 0)) AND c.path <> '' WHERE c.n <= {NS}"""


@query(f"{CLOUD_SQL}{_BY_COUNT}")
def kd_tiles_by_count(spark, sf_dir):
    """Tiles of at most NS points of a cloud with many ties, named as their files are."""
    tied = cloud(spark, sf_dir).select("id", *[F.round(c, 1).alias(c) for c in "xyz"])
    return kdtree.tiles(tied, NS).select("id", "tile_id", "tile_ord")


@query(f"{CLOUD_SQL}{_BY_COUNT.replace('SELECT c.id,', 'SELECT DISTINCT')}".replace("AS tile_id", "AS value").replace("concat('tile_'", "concat('out/tiles/tile_id=tile_'").replace("AS tile_ord\nFROM counted", "AS ord\nFROM counted"))
def tile_list(spark, sf_dir):
    """The list of the tiles."""
    tied = cloud(spark, sf_dir).select("id", *[F.round(c, 1).alias(c) for c in "xyz"])
    return sinks.tile_list_lines(kdtree.tiles(tied, NS), "out/tiles")


_SAVED = _BY_COUNT.replace("SELECT c.id,", f"SELECT c.id, {_E8}, w.fc, w.r, w.g, w.b,").replace(", cast(tile_ord AS bigint) AS tile_ord", "").replace("WHERE c.n <=", "JOIN cloud w ON w.id = c.id WHERE c.n <=")


@query(f"{CLOUD_SQL}{_SAVED}")
def tiles_saved(spark, sf_dir):
    """Tiles that were written as text and are read by their list."""
    return source.read_tiles(spark, _saved_tiles(spark, sf_dir), with_ids=True).withColumns({n: F.col(n) + F.lit(0.0) for n in "xyz"})


@query(f"{CLOUD_SQL}{_SAVED} AND tile_ord < 2")
def tiles_of_a_list(spark, sf_dir):
    """The first two tiles of a list; no other file is read."""
    at = _saved_tiles(spark, sf_dir)
    names = [x.rsplit("=", 1)[1] for x in source.read_tile_list(spark, at)[:2]]
    return source.read_tiles(spark, at, only=names, own_ids=True).withColumns({n: F.col(n) + F.lit(0.0) for n in "xyz"})


def _saved_tiles(spark, sf_dir) -> str:
    """The list of the cloud's tiles, which are written as text."""
    c = cloud(spark, sf_dir).select("id", "x", "y", "z", "fc", "r", "g", "b")
    at = folder(spark, "saved")
    tied = c.select("id", *[F.round(n, 1).alias(n) for n in "xyz"])
    sinks.write_tiles(c.join(kdtree.tiles(tied, NS).select("id", "tile_id", "tile_ord"), "id"), at, "cloud")
    return f"{at}/cloud.list"


# folds

_TILES = _KD[: _KD.index(", c2 AS")]  # two levels


def _fold_sql(metric: str, reach: str, cell: float | None, cost: str | None = None) -> str:
    """The fold in steps of one point: ``own`` lists the facility of each point so far, and what a step needs are the matrices of
    metric values and of facilities in reach. cell: size of the bins of which 27 are looked at. cost: that of a point as a
    facility, 1 if there is none."""
    one, instead, costs = ("C[n + 1]", "C[n + 1] - C[f] + ", f", list({cost} ORDER BY pi) AS C") if cost else ("1", "", "")
    lists = "pi, any_value(pid) AS id, " if cost else "pi, "
    pid, held = ("p.id AS pid, ", ", C") if cost else ("", "")
    bins = ", ".join(f"cast(floor(({c} - min({c}) OVER t) / (max({c}) OVER t - min({c}) OVER t) * greatest(1, ceil((max({c}) OVER t - min({c}) OVER t) / {cell})) * 0.99) as bigint) AS i{c}" for c in "xyz")
    cells = f", {bins}" if cell else ""
    beside = " AND ".join(f"abs(p.i{c} - q.i{c}) <= 1" for c in "xyz") if cell else "true"
    gain = "[G[n + 1][u] - G[f][u] FOR u IN range(1, n + 1) IF own[u] = f AND u <> f]"
    return f"""{CLOUD_SQL}{_TILES}, placed AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY id) AS i{cells} FROM t2 WINDOW t AS (PARTITION BY tile)),
values_ AS ({_MEASURED} (SELECT p.tile, {pid}p.i AS pi, q.i AS qi, {_BOTH}, {beside} AS beside FROM placed p JOIN placed q ON p.tile = q.tile)),
lines_ AS (SELECT tile, {lists}list({metric} ORDER BY qi) AS g, list(beside AND {reach} ORDER BY qi) AS near FROM values_ GROUP BY tile, pi),
matrix AS (SELECT tile, list(g ORDER BY pi) AS G, list(near ORDER BY pi) AS R{costs}, count(*) AS total FROM lines_ GROUP BY tile),
fold AS (SELECT tile, cast(1 as bigint) AS n, [cast(1 as bigint)] AS own FROM matrix
  UNION ALL SELECT tile, n + 1, CASE
      WHEN {one} <= join_ AND {one} <= taken THEN list_append(own, n + 1)
      WHEN join_ <= taken THEN list_append(own, who)
      ELSE list_append([CASE WHEN len([1 FOR m IN moves IF own[u] = m.f AND (m.whole OR (u <> m.f AND G[n + 1][u] < G[m.f][u]))]) > 0 THEN n + 1 ELSE own[u] END FOR u IN range(1, n + 1)], n + 1) END
  FROM (SELECT *, coalesce(list_min([o.d FOR o IN offers IF o.d > 0]), 1e300) AS join_,
      list_min([{{'d': o.d, 'f': o.f}} FOR o IN offers IF o.d > 0]).f AS who,
      {one} + coalesce(list_sum([least(o.full_, o.part) - {one} + o.d FOR o IN offers IF o.full_ <> o.part]), 0) AS taken,
      [{{'f': o.f, 'whole': o.full_ < o.part}} FOR o IN offers IF o.full_ <> o.part] AS moves
    FROM (SELECT tile, n, own, G{held}, [{{'f': f, 'd': G[n + 1][f], 'full_': {instead}coalesce(list_sum({gain}), 0), 'part': {one} - G[n + 1][f] + coalesce(list_sum([least(x, 0) FOR x IN {gain}]), 0)}}
        FOR f IN range(1, n + 1) IF own[f] = f AND R[n + 1][f]] AS offers FROM fold JOIN matrix USING (tile) WHERE n < total)))
SELECT cast(tile as varchar) AS tile_id, p.id, q.id AS fid FROM (SELECT tile, own FROM fold JOIN matrix USING (tile) WHERE n = total) JOIN placed p USING (tile) JOIN placed q USING (tile) WHERE q.i = own[p.i]"""


def _tiled(spark, sf_dir) -> DataFrame:
    return tiling.kd_tiles(cloud(spark, sf_dir), 2).withColumns({"tile_id": F.col("tile").cast("string"), "pos": F.col("id")})


_MIX = "CASE WHEN dist < 1e-37 THEN 0 ELSE 0.95 * ({}) + 0.05 * dist + CASE WHEN dist >= {} THEN 0.95 * {} ELSE 0 END END"


@query(_fold_sql(_MIX.format(_DFP, 0.2, "(dist - 0.2)"), "dist <= 0.2", 0.2))
def facility_fold(spark, sf_dir):
    return facility.cluster(_tiled(spark, sf_dir), facility.Params(norm="dfp", lam=0.2, bin=0.2))


_COST = "0.05 + 0.03 * (id % 5)"


@query(_fold_sql("dist", "dist <= 0.2", 0.2, _COST))
def facility_fold_costs(spark, sf_dir):
    """Points that cost differently as facilities."""
    return facility.cluster(_tiled(spark, sf_dir).withColumn("fc", F.expr(f"cast({_COST} as double)")), facility.Params(norm="l2", lam=0.2, bin=0.2))


@query(_fold_sql("dist", "dist <= 0.2", None))
def facility_fold_radius(spark, sf_dir):
    return facility.cluster(_tiled(spark, sf_dir), facility.Params(norm="l2", lam=0.2, bin=0.2, candidate_mode="radius"))


@query(_fold_sql("dist", "dist <= 0.2", None, _COST))
def facility_fold_stream(spark, sf_dir):
    """Points that come in four batches; a tile ends with its last point."""
    rows = _tiled(spark, sf_dir).withColumns({"fc": F.expr(f"cast({_COST} as double)"), "tile_size": F.expr("count(*) OVER (PARTITION BY tile_id)")})
    rows = materialize(rows.withColumn("part", F.expr("ntile(4) OVER (PARTITION BY tile_id ORDER BY pos, id)")), "tiled")
    params = facility.Params(norm="l2", lam=0.2, bin=0.2, candidate_mode="radius")
    return point_fold.cluster_in_batches([rows.filter(F.col("part") == i).drop("part") for i in range(1, 5)], params, folder(spark, "stream"))


@query(_fold_sql(_MIX.format(_ABN, 0.1, "1"), "dist < 3 * 0.1", None))
def facility_fold_flat(spark, sf_dir):
    """As the first revision: all facilities within three times lambda."""
    return facility.cluster(_tiled(spark, sf_dir), facility.revision("v0", norm="abn", lam=0.1, bin=0.1))


@query(_fold_sql(_MIX.format(_ABN, 0.1, "1"), "dist < 3 * 0.1", 0.3))
def facility_fold_wide(spark, sf_dir):
    """As the second revision: those of 27 cells within three times lambda."""
    return facility.cluster(_tiled(spark, sf_dir), facility.revision("v1", norm="abn", lam=0.1, bin=0.3))


@query(_fold_sql("greatest(abs(ax - ox), abs(ay - oy), abs(az - oz))", "dist <= 0.2", 0.2))
def facility_fold_own_metric(spark, sf_dir):
    return facility.cluster(_tiled(spark, sf_dir), facility.Params(metric=_largest_difference, lam=0.2, bin=0.2))


def _largest_difference(a: dict, b: dict, p: facility.Params):
    return np.maximum(np.maximum(np.abs(a["x"] - b["x"]), np.abs(a["y"] - b["y"])), np.abs(a["z"] - b["z"]))


def _features(spark, sf_dir) -> DataFrame:
    c = _tiled(spark, sf_dir).select("id", "x", "y", "z", "tile_id")
    return c.join(regions.features(planes.planes(c, knn(c, K, by="tile_id"))), "id")


def _edges(spark, sf_dir) -> DataFrame:
    return materialize(_features(spark, sf_dir).filter(F.col("curv") > EDGE), "edges")


_NEAR_IN_TILE = f""", knn AS (SELECT tile, qid, nid, rank FROM (SELECT q.tile, q.id AS qid, p.id AS nid, row_number() OVER (PARTITION BY q.id ORDER BY (q.x-p.x)^2 + (q.y-p.y)^2 + (q.z-p.z)^2, p.id) AS rank
  FROM t2 q JOIN t2 p ON p.tile = q.tile) WHERE rank <= {K}), own AS (SELECT qid, {_MOMENTS} FROM knn JOIN cloud ON nid = id GROUP BY qid)"""
_UNIT = lambda v: ", ".join(f"{v}.{c} / sqrt({v}.s) * CASE WHEN {v}.z <> 0 THEN sign({v}.z) WHEN {v}.y <> 0 THEN sign({v}.y) ELSE sign({v}.x) END AS {v}{c}" for c in "xyz")


def _grow_matrix(vector: str, k: int, only_edges: bool) -> str:
    """CTE ``matrix``: for each tile neighbours N, distances D, vectors V and whether a point is an edge point, E."""
    chosen = f"WHERE curv > {EDGE}" if only_edges else ""
    return f"""{CLOUD_SQL}{_TILES}{_NEAR_IN_TILE}{_eigen("own", "qid")}, two AS (SELECT qid, l3/(l1 + l2 + l3) AS curv, {_axis("l3", "n")}, {_axis("l1", "t")} FROM eig),
feature AS (SELECT t2.tile, t2.id, t2.x, t2.y, t2.z, curv, {_UNIT("n")}, {_UNIT("t")} FROM two JOIN t2 ON t2.id = qid),
edge AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY id) AS i FROM feature {chosen}),
pair AS (SELECT p.tile, p.i AS pi, q.i AS qi, sqrt((p.x-q.x)^2 + (p.y-q.y)^2 + (p.z-q.z)^2) AS d, row_number() OVER (PARTITION BY p.tile, p.i ORDER BY (p.x-q.x)^2 + (p.y-q.y)^2 + (p.z-q.z)^2, q.id) AS rank FROM edge p JOIN edge q ON p.tile = q.tile),
row_ AS (SELECT tile, pi, list(qi ORDER BY rank) FILTER (rank <= {k}) AS near, list(d ORDER BY qi) AS far FROM pair GROUP BY tile, pi),
matrix AS (SELECT row_.tile, list(near ORDER BY pi) AS N, list(far ORDER BY pi) AS D, list({{'x': {vector}x, 'y': {vector}y, 'z': {vector}z, 'c': curv}} ORDER BY pi) AS V, list(curv > {EDGE} ORDER BY pi) AS E, count(*) AS total
  FROM row_ JOIN edge ON edge.tile = row_.tile AND edge.i = pi GROUP BY row_.tile),
"""


def _grow_sql(vector: str, fits: str, k: int, least: int, merge: str | None, only_edges: bool = True) -> str:
    """Growth in steps: a seed, a point that is reached, or the end of a region. ``fits`` compares {{a}} with {{b}}, structs of the
    vector's mean or the vector (x, y, z) and of curvatures (c). merge: largest distance of regions that merge, and whether to
    stop then; None for the rule that compares a point with the one before it."""
    mean = ", ".join(f"'{c}': (m.{c} * len(region) + V[spot].{c}) / (len(region) + 1)" for c in "xyzc")
    apart = "greatest(list_max([list_min([D[a][b] FOR b IN r.p]) FOR a IN region]), list_max([list_min([D[a][b] FOR a IN region]) FOR b IN r.p]))"
    distance, stop = merge.split() if merge else ("-1", "false")
    like = f"({fits.format(a='m', b='r.m')} AND {apart} < {distance})" if merge else "false"
    met = "list_reverse([r FOR r IN regions IF r.near])"
    middle = ", ".join(f"'{c}': list_reduce(list_concat([m.{c}], [r.m.{c} FOR r IN {met}]), lambda u, v: (u + v) / 2)" for c in "xyzc")
    now = f"{{{mean}}}" if merge else "V[spot]"
    return f"""{_grow_matrix(vector, k, only_edges)}grown AS (SELECT tile, [false FOR u IN range(total)] AS seen, []::BIGINT[] AS queue, []::BIGINT[] AS region, V[1] AS m,
    []::STRUCT(p BIGINT[], m STRUCT(x DOUBLE, y DOUBLE, z DOUBLE, c DOUBLE))[] AS regions, false AS stop FROM matrix
  UNION ALL SELECT tile, seen_, CASE
      WHEN mode = 'walk' THEN [j FOR j IN list_concat(list_slice(queue, 2, len(queue)), [j FOR j IN N[spot] IF E[j] AND {fits.format(a='now', b='V[j]')}]) IF NOT seen_[j]]
      WHEN mode = 'seed' AND spot IS NOT NULL THEN [spot] ELSE [] END,
    CASE WHEN mode = 'walk' THEN list_append(region, spot) ELSE [] END, now,
    CASE WHEN mode = 'close' AND len(region) > {least} THEN list_append([{{'p': r.p, 'm': r.m}} FOR r IN regions IF NOT r.near], {{'p': list_concat(region, flatten([r.p FOR r IN {met}])), 'm': {{{middle}}}}})
      ELSE [{{'p': r.p, 'm': r.m}} FOR r IN regions] END,
    (mode = 'seed' AND spot IS NULL) OR (mode = 'close' AND len(region) > {least} AND {stop} AND len({met}) > 0)
  FROM (SELECT * REPLACE ([{{'p': r.p, 'm': r.m, 'near': mode = 'close' AND {like}}} FOR r IN regions] AS regions), CASE WHEN mode = 'walk' THEN {now} ELSE m END AS now,
      CASE WHEN mode = 'walk' THEN [s OR u = spot FOR s, u IN seen] ELSE seen END AS seen_
    FROM (SELECT g.*, N, D, V, E, CASE WHEN len(queue) > 0 THEN 'walk' WHEN len(region) > 0 THEN 'close' ELSE 'seed' END AS mode,
        CASE WHEN len(queue) > 0 THEN queue[1] ELSE nullif(list_position(seen, false), 0) END AS spot FROM grown g JOIN matrix USING (tile) WHERE NOT stop)))
SELECT cast(tile as varchar) AS tile_id, cast(r - 1 as bigint) AS region_id, edge.id, cast(o - 1 as bigint) AS ord
FROM (SELECT tile, r, unnest(p) AS i, generate_subscripts(p, 1) AS o FROM (SELECT tile, unnest(regions).p AS p, generate_subscripts(regions, 1) AS r FROM grown WHERE stop)) JOIN edge USING (tile, i)"""


def _grow_dynamic_sql(fits: str, k: int, least: int, reach: float) -> str:
    """Growth on contact in steps: a seed, a point whose neighbours are looked at, one neighbour, or the end of a region. ``owner``
    is the number of a point's region, -1 for the one that grows, 0 for none."""
    mean = ", ".join(f"'{c}': (m.{c} * len(region) + V[j].{c}) / (len(region) + 1)" for c in "xyzc")
    half = ", ".join(f"'{c}': (regions[owner[j]].m.{c} + m.{c}) / 2" for c in "xyzc")
    gap = "coalesce(list_min([D[j][u] FOR u IN {}]), 1e300)"
    return f"""{_grow_matrix("t", k, True)}
grown AS (SELECT tile, [false FOR u IN range(total)] AS seen, [cast(0 as bigint) FOR u IN range(total)] AS owner, cast(0 as bigint) AS seed, []::BIGINT[] AS queue, cast(0 as bigint) AS spot, cast(0 as bigint) AS k,
    []::BIGINT[] AS region, V[1] AS m, []::STRUCT(p BIGINT[], m STRUCT(x DOUBLE, y DOUBLE, z DOUBLE, c DOUBLE))[] AS regions, false AS active, false AS stop FROM matrix
  UNION ALL SELECT tile,
    CASE WHEN mode = 'add' THEN [x OR u = j FOR x, u IN seen] WHEN mode = 'close' AND len(region) <= {least} THEN [x AND owner[u] <> -1 FOR x, u IN seen] ELSE seen END,
    CASE WHEN mode = 'add' THEN [CASE WHEN u = j THEN -1 ELSE x END FOR x, u IN owner] WHEN mode = 'merge' THEN [CASE WHEN x = -1 THEN owner[j] ELSE x END FOR x IN owner]
      WHEN mode = 'close' THEN [CASE WHEN x <> -1 THEN x WHEN len(region) > {least} THEN len(regions) + 1 ELSE 0 END FOR x IN owner]
      WHEN mode = 'seed' THEN [CASE WHEN u = j THEN -1 ELSE x END FOR x, u IN owner] ELSE owner END,
    CASE WHEN mode = 'seed' THEN coalesce(j, seed) ELSE seed END,
    CASE WHEN mode = 'seed' THEN [j] WHEN mode = 'add' THEN list_append(queue, j) WHEN mode = 'pop' THEN list_slice(queue, 2, len(queue)) WHEN mode = 'merge' THEN [] ELSE queue END,
    CASE WHEN mode = 'pop' THEN queue[1] WHEN mode IN ('seed', 'merge', 'close') THEN 0 ELSE spot END,
    CASE WHEN mode = 'pop' THEN 1 WHEN mode IN ('add', 'skip') THEN k + 1 ELSE 0 END,
    CASE WHEN mode = 'seed' THEN [j] WHEN mode = 'add' THEN list_append(region, j) WHEN mode IN ('merge', 'close') THEN [] ELSE region END,
    CASE WHEN mode = 'seed' THEN V[j] WHEN mode = 'add' THEN {{{mean}}} ELSE m END,
    CASE WHEN mode = 'close' AND len(region) > {least} THEN list_append(regions, {{'p': region, 'm': m}})
      WHEN mode = 'merge' THEN [CASE WHEN i = owner[j] THEN {{'p': list_concat(r.p, region), 'm': {{{half}}}}} ELSE r END FOR r, i IN regions] ELSE regions END,
    mode IN ('add', 'skip', 'pop') OR (mode = 'seed' AND j IS NOT NULL), mode = 'seed' AND j IS NULL
  FROM (SELECT *, CASE WHEN NOT active THEN 'seed' WHEN j IS NULL THEN CASE WHEN len(queue) > 0 THEN 'pop' ELSE 'close' END
      WHEN NOT ({fits.format(a="m", b="V[j]")} AND {gap.format("region")} < {reach}) THEN 'skip' WHEN owner[j] = 0 THEN 'add'
      WHEN owner[j] > 0 AND {fits.format(a="regions[owner[j]].m", b="V[j]")} AND {gap.format("regions[owner[j]].p")} < {reach} THEN 'merge' ELSE 'skip' END AS mode
    FROM (SELECT g.*, N, D, V, E, CASE WHEN active THEN CASE WHEN spot > 0 THEN N[spot][g.k] END ELSE list_min([u FOR x, u IN seen IF NOT x AND u > seed]) END AS j FROM grown g JOIN matrix USING (tile) WHERE NOT stop)))
SELECT cast(tile as varchar) AS tile_id, cast(r - 1 as bigint) AS region_id, edge.id, cast(o - 1 as bigint) AS ord
FROM (SELECT tile, r, unnest(p) AS i, generate_subscripts(p, 1) AS o FROM (SELECT tile, unnest(regions).p AS p, generate_subscripts(regions, 1) AS r FROM grown WHERE stop)) JOIN edge USING (tile, i)"""


_TURN = "acos(least(1, abs({a}.x*{b}.x + {a}.y*{b}.y + {a}.z*{b}.z) / (sqrt({a}.x^2 + {a}.y^2 + {a}.z^2) * sqrt({b}.x^2 + {b}.y^2 + {b}.z^2))))"


@query(_grow_sql("t", _TURN + " < 0.8", 10, 3, "0.1 true"))
def region_grow(spark, sf_dir):
    return regions.grow_regions(_edges(spark, sf_dir), regions.Rule(angle=0.8, min_points=3))


@query(_grow_sql("t", _TURN + " < 0.8", 10, 3, "0.1 false"))
def region_grow_all(spark, sf_dir):
    """The scan goes on after a merge."""
    return regions.grow_regions(_edges(spark, sf_dir), regions.Rule(angle=0.8, min_points=3, stop_at_merge=False))


@query(_grow_sql("n", _TURN + " < 0.9 AND abs({a}.c - {b}.c) < 0.05", 10, 3, None, False))
def region_grow_fixed(spark, sf_dir):
    """As older revisions: points are compared with the point before them."""
    rows = materialize(_features(spark, sf_dir).withColumn("edge", F.col("curv") > EDGE), "features")
    return regions.grow_regions(rows, regions.Rule(angle=0.9, curvature=0.05, min_points=3), "fixed")


@query(_grow_sql("n", "abs({a}.x*{b}.x + {a}.y*{b}.y + {a}.z*{b}.z) > 0.7", 10, 3, "0.1 false"))
def region_grow_own_rule(spark, sf_dir):
    """A function as the rule: normals within a limit."""
    rule = regions.Rule(min_points=3, stop_at_merge=False, fits=lambda a, b: abs(float(a[4:7] @ b[4:7])) > 0.7)
    return regions.grow_regions(_edges(spark, sf_dir), rule)


@query(_grow_dynamic_sql(_TURN + " < 0.8", 10, 3, 0.2))
def region_grow_dynamic(spark, sf_dir):
    return regions.grow_regions(_edges(spark, sf_dir), regions.Rule(angle=0.8, distance=0.2, min_points=3), "dynamic")


_NONE_OFF = "SELECT cast(5000 as bigint) AS n, cast(0 as bigint) AS off, true AS mixed"


def _off(points: DataFrame, off: str, share: str, least: float, most: float) -> DataFrame:
    """Points, those off the surface, and whether the share of a part lies within bounds far wider than chance."""
    part = F.count_if(F.expr(share)) / F.count(F.lit(1))
    return points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(off)).alias("off"), part.between(least, most).alias("mixed"))


@query(_NONE_OFF)
def generate_cone(spark, sf_dir):
    """Points off the side and off the disk below; the disk has 0.2709 of the area."""
    off = "(abs(sqrt(x*x+y*y) - 0.5*(-z)/1.25) > 1e-9 AND abs(z + 1.25) > 1e-9) OR z > 0 OR z < -1.25 OR sqrt(x*x+y*y) > 0.5 + 1e-9"
    return _off(generate.cone(spark, 1.25, 0.5, 5000), off, "abs(z + 1.25) < 1e-9", 0.23, 0.31)


@query(_NONE_OFF)
def generate_cylinder(spark, sf_dir):
    """The base has 0.1429 of the points, as by the original."""
    off = "(abs(sqrt(x*x+y*y) - 0.5) > 1e-9 AND abs(z + 1.25) > 1e-9) OR z > 0 OR z < -1.25 OR sqrt(x*x+y*y) > 0.5 + 1e-9"
    return _off(generate.cylinder(spark, 1.25, 0.5, 5000), off, "abs(z + 1.25) < 1e-9", 0.11, 0.18)


@query(_NONE_OFF)
def generate_cube(spark, sf_dir):
    off = "NOT (x IN (0D, 2D) OR y IN (0D, 2D) OR z IN (0D, 2D, -2D)) OR least(x, y, abs(z)) < 0 OR greatest(x, y, abs(z)) > 2"
    return _off(generate.cube(spark, 2.0, 5000), off, "x IN (0D, 2D)", 0.28, 0.39)


@query("SELECT cid, cast(100 as bigint) AS n, true AS small FROM (SELECT unnest(range(5)) AS cid)")
def generate_clusters(spark, sf_dir):
    """Points of each cluster, and whether they fill a flat square of the given size."""
    rows = generate.clusters(spark, 10, 10, 0.5, 5, 100, compat=False)
    side = [F.max(c) - F.min(c) for c in "xy"]
    small = (side[0] <= 0.5) & (side[1] <= 0.5) & (side[0] > 0.3) & (side[1] > 0.3) & (F.max(F.abs("z")) == 0)
    return rows.groupBy(F.floor(F.col("id") / 100).alias("cid")).agg(F.count(F.lit(1)).alias("n"), small.alias("small"))
