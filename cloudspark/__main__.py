"""Command line.

``python -m cloudspark cluster FILE OUT [+norm=dfp +fc=0.01 +lambda=0.25 +ns=100000 +knn=50 +mju=0.95 +bin=0.25 +l=1] [-n] [-s] [-e]``
clusters a cloud; FILE may be a tile list (``*.list``). -n recomputes costs by local roughness, -s adds statistics, -e a drawing.
``python -m cloudspark export --points P --clusters C --centroids I --column N --out O`` joins clusters to coordinates.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudspark.operators import facility, kdtree, planes, stats
from cloudspark.operators.knn import knn
from cloudspark.plans.storage import materialize
from cloudspark.sources import dxf, points, sinks

DEFAULTS = {"norm": "abn", "fc": 0.01, "lambda": 0.25, "ns": 100_000, "knn": 50, "mju": 0.95, "bin": 0.25, "l": 1.0}


def parse(args: list[str]) -> tuple[list[str], dict, set[str]]:
    """Plain arguments, +name=value settings over DEFAULTS, and -x switches."""
    short = {"lam": "lambda", "met": "norm"}
    settings, plain, switches = dict(DEFAULTS), [], set()
    for arg in args:
        if arg.startswith("+"):
            name, _, value = arg[1:].partition("=")
            name = short.get(name, name)
            if name not in settings:
                raise SystemExit(f"unknown setting {arg}")
            settings[name] = type(DEFAULTS[name])(value)
        elif arg in ("-n", "-s", "-e"):
            switches.add(arg[1:])
        else:
            plain.append(arg)
    return plain, settings, switches


def load(spark: SparkSession, path: str, settings: dict, non_uniform: bool) -> DataFrame:
    """The cloud with tile_id and pos: the tiles of a list, or median tiles of at most ``ns`` points."""
    if path.endswith(".list"):
        cloud = materialize(points.read_tiles(spark, path, fc=settings["fc"], non_uniform=non_uniform), "cloud")
        if (repeated := cloud.groupBy("id").count().filter("count > 1").first()) is not None:
            raise SystemExit(f"id {repeated.id} is not unique over the tiles of {path}")
        return cloud.withColumn("pos", F.col("id"))
    cloud = materialize(points.read_points(spark, path, fc=settings["fc"], non_uniform=non_uniform), "cloud")
    return kdtree.tiles(cloud, settings["ns"]).withColumn("pos", F.col("id"))


def cluster(spark: SparkSession, path: str, out: str, settings: dict, switches: set[str]) -> None:
    """Writes points, facilities, facility lists, the client map and, unless FILE is a tile list, the tiles and their list,
    which a later call can start from; nothing that exists is overwritten.

    Planes use neighbours on both sides of a tile's border; clusters never cross it.
    """
    cloud = materialize(load(spark, path, settings, "n" in switches), "tiles")
    fitted = planes.planes(cloud, knn(cloud, settings["knn"])).withColumnRenamed("qid", "id")
    cloud = cloud.join(fitted, "id")
    if "n" in switches:
        cloud = cloud.withColumn("fc", F.expr(planes.recomputed_cost()))
    cloud = materialize(cloud, "planes")
    p = facility.Params(norm=settings["norm"], fc=settings["fc"], lam=settings["lambda"], bin=settings["bin"], mju=settings["mju"], power=settings["l"])
    found = materialize(facility.cluster(cloud, p).select("id", "fid"), "assignment")
    own = cloud.select(*sinks.POINT).join(found.filter("id = fid").select("id"), "id")
    if not path.endswith(".list"):
        sinks.write_tiles(cloud, out, "tiles")
    sinks.write(sinks.point_lines(cloud), f"{out}/points")
    sinks.write(sinks.facility_lines(own), f"{out}/facilities")
    sinks.write(sinks.id_lines(stats.facility_lists(found)), f"{out}/facility_ids")
    sinks.write(sinks.map_lines(found), f"{out}/client_map")
    if "s" in switches:
        shape = stats.cluster_stats(cloud, found, lam=p.lam, mju=p.mju, power=p.power)
        reach = shape.agg(F.max("rad")).first()[0] or p.lam
        table = own.join(shape, own["id"] == shape["fid"]).drop("fid").join(stats.overlap(cloud, found, reach).withColumnRenamed("fid", "id"), "id")
        sinks.write(sinks.statistics_lines(table), f"{out}/statistics")
    if "e" in switches:
        sinks.write(dxf.drawing_lines(dxf.cluster_entities(cloud, found, stats.bounding_boxes(cloud, found))), f"{out}/clusters.dxf")


def export(spark: SparkSession, args: list[str]) -> None:
    ap = argparse.ArgumentParser(prog="cloudspark export")
    for name in ("points", "clusters", "centroids", "out"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--column", type=int, default=0)
    a = ap.parse_args(args)
    rows = stats.export_clusters(
        points.read_points(spark, a.points), points.parse_clusters(points.read_lines(spark, a.clusters)), points.parse_centroids(points.read_lines(spark, a.centroids), a.column)
    )
    sinks.write(sinks.export_lines(rows), a.out)


def main(args: list[str], spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.builder.getOrCreate()
    if args[:1] == ["export"]:
        export(spark, args[1:])
        return
    plain, settings, switches = parse(args[1:])
    if args[:1] != ["cluster"] or len(plain) != 2:
        raise SystemExit(__doc__)
    cluster(spark, *plain, settings, switches)


if __name__ == "__main__":
    main(sys.argv[1:])
