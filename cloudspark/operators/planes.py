"""Local planes by principal components of the neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudspark.functions.metrics import angle, eigen_steps

COV = {"xx": ("x", "x"), "xy": ("x", "y"), "xz": ("x", "z"), "yy": ("y", "y"), "yz": ("y", "z"), "zz": ("z", "z")}


def covariance(points: DataFrame, by: str) -> DataFrame:
    """n, centroid and sample covariance of each group; a group of one point has covariance 0."""
    moments = [F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(k) for k, (a, b) in COV.items()]
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *moments)


def with_eigenvalues(cov: DataFrame, out: str = "l") -> DataFrame:
    """Step by step, so that no expression is repeated in the generated code."""
    for name, e in eigen_steps(out=out).items():
        cov = cov.withColumn(name, F.expr(e))
    return cov.drop("_q", "_s", "_phi")


def neighbourhoods(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Rows (qid, x, y, z) of each point's neighbours."""
    if {"x", "y", "z"} <= set(neighbours.columns):
        return neighbours.select("qid", "x", "y", "z")
    return neighbours.select("qid", F.col("nid").alias("id")).join(points.select("id", "x", "y", "z"), "id").drop("id")


PLANE = "qid long, na double, nb double, nc double, nw double, l1 double, l2 double, l3 double, t1 double, t2 double, t3 double, height double"


def _turned(v: np.ndarray) -> np.ndarray:
    big = np.where(np.abs(v) > 1e-12, v, 0)
    lead = np.where(big[:, 2] != 0, big[:, 2], np.where(big[:, 1] != 0, big[:, 1], big[:, 0]))
    return v * np.where(lead < 0, -1, 1)[:, None]


def fit_planes(xyz: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Planes of groups of points that lie one after the other: normal, offset, eigenvalues, tangent and height as columns.

    The last non-zero part of normals and tangents is positive. The height is the least extent along the three principal axes.
    """
    n = np.diff(np.append(starts, len(xyz)))
    group = np.repeat(np.arange(len(n)), n)
    mean = np.add.reduceat(xyz, starts) / n[:, None]
    off = xyz - mean[group]
    cov = np.add.reduceat(off[:, :, None] * off[:, None, :], starts) / np.maximum(n - 1, 1)[:, None, None]
    values, axes = np.linalg.eigh(cov)
    normal, tangent = _turned(axes[:, :, 0]), _turned(axes[:, :, 2])
    along = np.einsum("ij,ijk->ik", off, axes[group])
    height = (np.maximum.reduceat(along, starts) - np.minimum.reduceat(along, starts)).min(1)
    return np.column_stack([normal, -(normal * mean).sum(1), np.maximum(values[:, ::-1], 0), tangent, height])


def planes(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """For each point (qid) its plane na, nb, nc, nw, eigenvalues, tangent and ``height``, in one pass over its neighbours,
    whose number the search has bounded."""
    names = [c.split()[0] for c in PLANE.split(", ")]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            flat = lists.flatten()
            xyz = np.column_stack([c.to_numpy(zero_copy_only=False) for c in flat.flatten()])
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, fit_planes(xyz, starts).T)], names=names)

    near = neighbourhoods(points, neighbours).groupBy("qid").agg(F.collect_list(F.struct("x", "y", "z")).alias("near"))
    return near.mapInArrow(run, PLANE)


def svd_planes(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Planes as older revisions fit them, by singular values of the centred neighbours: qid, na, nb, nc, nw, ``sigma`` (the
    least singular value) and ``var`` (its share of all three). Fewer than three neighbours have the default plane, the
    normal along x, with sigma and var 0. The squares of singular values are the scatter's eigenvalues."""
    counts = neighbours.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    fitted = planes(points, neighbours).join(counts, "qid")
    size = {i: F.sqrt(F.col(f"l{i}") * (F.col("n") - 1)) for i in (1, 2, 3)}
    var = size[3] / F.nullif(size[1] + size[2] + size[3], F.lit(0.0))
    rows = fitted.select("qid", "n", "na", "nb", "nc", "nw", size[3].alias("sigma"), F.coalesce(var, F.lit(0.0)).alias("var"))
    default = {"na": 1.0, "nb": 0.0, "nc": 0.0, "nw": 0.0, "sigma": 0.0, "var": 0.0}
    return rows.select("qid", *[F.when(F.col("n") < 3, F.lit(o)).otherwise(F.col(c)).alias(c) for c, o in default.items()])


def angle_spread(planes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, spread): the largest distance of a neighbour times the sine of half the angle of normals (older revisions).
    neighbours: with d2; planes: qid and the normal."""
    a = planes.select(F.col("qid").alias("id"), *[F.col(f"n{c}").alias(f"an{c}") for c in "abc"])
    b = planes.select(F.col("qid").alias("nid"), *[F.col(f"n{c}").alias(f"on{c}") for c in "abc"])
    pairs = neighbours.select(F.col("qid").alias("id"), "nid", "d2").join(a, "id").join(b, "nid")
    return pairs.groupBy("id").agg(F.max(F.sqrt("d2") * F.sin(F.expr(angle()) / 2)).alias("spread"))


def recomputed_cost(fc: str = "fc", height: str = "height") -> str:
    """Facility cost by local roughness, as SQL."""
    return f"least(power({fc}/({height}+0.0001), 2.0), 10000.0)"


def bounded_cost(fc: str = "fc", spread: str = "height") -> str:
    """The cost rule of older revisions: within a factor of 10 of the given cost."""
    return f"least(greatest({fc}*{fc}/({spread}+0.0001), {fc}/10), 10*{fc})"
