"""Synthetic clouds with real ids and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(spark: SparkSession, n: int, seed: int, draws: int) -> DataFrame:
    df = spark.range(n)
    for i in range(draws):
        df = df.withColumn(f"u{i}", F.rand(seed + i))
    return df


def clusters(spark: SparkSession, w: float, h: float, rad: float, nc: int, n: int, seed: int = 0, compat: bool = True) -> DataFrame:
    """nc flat squares of n points. ``compat``: y runs from the centre to ``rad`` as in the original, not to centre + rad."""
    centres = spark.range(nc).select(F.col("id").alias("cid"), (F.rand(seed) * w - rad).alias("xc"), (F.rand(seed + 1) * h - rad).alias("yc"))
    high = F.lit(rad) if compat else F.col("yc") + rad
    rows = centres.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select((F.col("cid") * n + F.col("j")).alias("id"), (F.col("xc") + F.rand(seed + 2) * rad).alias("x"), (F.col("yc") + F.rand(seed + 3) * (high - F.col("yc"))).alias("y"), F.lit(0.0).alias("z"))


def cone(spark: SparkSession, a: float, b: float, n: int, seed: int = 0) -> DataFrame:
    """Height a, radius b; apex at the origin, base at z = -a, points in proportion to area."""
    base = b / (b + (a * a + b * b) ** 0.5)
    df = _base(spark, n, seed, 3).withColumn("r", F.sqrt("u1")).withColumn("t", F.col("u2") * 6.283185307179586)
    h = F.when(F.col("u0") < base, F.lit(a)).otherwise(F.col("r") * a)
    return df.select("id", (F.col("r") * b * F.cos("t")).alias("x"), (F.col("r") * b * F.sin("t")).alias("y"), (-h).alias("z"))


def cylinder(spark: SparkSession, a: float, b: float, n: int, seed: int = 0, compat: bool = True) -> DataFrame:
    """Height a, radius b, one base. ``compat``: the original's share of base points, b / 2(a + b), not b / (a + b)."""
    base = b / (2 * (a + b)) if compat else b / (a + b)
    df = _base(spark, n, seed, 3).withColumn("t", F.col("u2") * 6.283185307179586)
    on_base = F.col("u0") < base
    r = F.when(on_base, F.sqrt("u1") * b).otherwise(F.lit(b))
    h = F.when(on_base, F.lit(a)).otherwise(F.col("u1") * a)
    return df.select("id", (r * F.cos("t")).alias("x"), (r * F.sin("t")).alias("y"), (-h).alias("z"))


def cube(spark: SparkSession, a: float, n: int, seed: int = 0) -> DataFrame:
    """Edge a; six faces alike."""
    df = _base(spark, n, seed, 3).withColumn("face", F.floor(F.col("u0") * 6))
    u, v, fixed = F.col("u1") * a, F.col("u2") * a, F.when(F.col("face") % 2 == 0, 0.0).otherwise(F.lit(a))
    axis = F.floor(F.col("face") / 2)
    return df.select("id", F.when(axis == 0, fixed).otherwise(u).alias("x"), F.when(axis == 1, fixed).when(axis == 0, u).otherwise(v).alias("y"), F.when(axis == 2, fixed).otherwise(v).alias("z"))
