"""An index for nearest neighbours that is saved, opened again, and takes insertions and removals.

It is a few static trees of boxes (``kdtree``). A batch of new points is a tree of its own, joined with the last trees as long as those
are no larger, so there are at most about log2(n) trees and a point is built into as many. A removal lowers the counts of the nodes above a
point and notes its id at its leaf; trees with half of their points removed are built again, as one. All trees are searched at once: a query's
bound comes from the boxes of all of them.

The points of a tree are a table bucketed by leaf, so that a search moves the boxes that queries want and never the points.
Each change is a new row of the list of trees, written last; a change that is lost leaves the index as it was. What older rows name
is kept for those who still read it. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudspark.operators import kdtree
from cloudspark.plans.storage import lookup, materialize

AXES = kdtree.AXES
#: A tree: its number, table of points and their place, folder of nodes, depth, buckets, points when it was built and now, and whether some were removed.
TREE = "number:long, points:string, at:string, nodes:string, depth:int, buckets:int, built:long, live:long, removed:boolean"


class NeighbourIndex:
    """Points (id, x, y, z) by place; ids are longs, and no two points that are there have the same.

    Rows with a null are no points. A point that was removed may come again. An empty index has no neighbours.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, trees: list[dict]):
        self.spark, self.path, self.version, self.trees = spark, path.rstrip("/"), version, trees

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> NeighbourIndex:
        """An empty index in a new folder that all machines share."""
        return cls(spark, path, 0, [])._commit([])

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> NeighbourIndex:
        """The index as it is, or as it was at a version."""
        rows = spark.read.schema(f"trees array<struct<{TREE}>>, version int").parquet(f"{path.rstrip('/')}/versions")
        rows = rows.groupBy().agg(F.max_by("trees", "version").alias("trees"), F.max("version").alias("version")) if version is None else rows.filter(F.col("version") == version)
        row = rows.first()
        return cls(spark, path, row.version, [t.asDict() for t in row.trees])

    def insert(self, points: DataFrame) -> NeighbourIndex:
        """The index with ``points``, too."""
        new = materialize(points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in AXES]).dropna(), "new")
        size = new.count()
        if not size:
            return self
        trees = list(self.trees)
        while trees and trees[-1]["live"] <= size:
            last = trees.pop()
            new, size = new.unionByName(self._points(last)), size + last["live"]
        return self._commit([*trees, self._build(new)])

    def remove(self, ids: DataFrame) -> NeighbourIndex:
        """The index without the points of ``ids`` (id); ids that are not there change nothing."""
        gone = lookup(materialize(ids.select(F.col("id").cast("long").alias("id")).dropna().distinct(), "gone"))
        trees, left = [], None
        for tree in self.trees:
            lost = materialize(self._points(tree, "path").join(gone, "id", "left_semi").select("path", "id"), "lost")
            n = lost.count()
            live = tree["live"] - n
            if not n:
                trees.append(tree)
            elif 2 * live >= tree["built"]:
                nodes = self._new("nodes")
                self._less(tree, lost).write.parquet(nodes)
                trees.append({**tree, "nodes": nodes, "live": live, "removed": True})
            elif live:
                own = self._points(tree, "path").join(lost, ["path", "id"], "left_anti").drop("path")
                left = own if left is None else left.unionByName(own)
        if left is not None:  # one tree, as each has a number of its own
            trees.append(self._build(left))
        return self._commit(trees) if trees != self.trees else self

    def points(self) -> DataFrame:
        """(id, x, y, z) of all points that are there."""
        out = self.spark.createDataFrame([], "id long, x double, y double, z double")
        for tree in self.trees:
            out = out.unionByName(self._points(tree))
        return out

    def knn(self, queries: DataFrame, k: int | str, radius: float | None = None, eps: float = 0.0) -> DataFrame:
        """(qid, nid, d2, rank, x, y, z of the neighbour) for queries (id, x, y, z); all else as by ``kdtree.knn``."""
        count = F.lit(k) if isinstance(k, int) else F.col(k)
        places = [F.col(c).cast("double").alias(f"q{c}") for c in AXES]
        own = queries.select(F.col("id").alias("qid"), F.lit("").alias("g"), *places, F.greatest(count, F.lit(1)).cast("int").alias("k")).dropna(subset=["qx", "qy", "qz"])
        if not self.trees:
            none = self.points().withColumnRenamed("id", "nid")
            return own.crossJoin(none.limit(0)).select("qid", "nid", F.lit(0.0).alias("d2"), F.col("k").alias("rank"), *AXES)
        nodes = self._nodes(self.trees[0])
        for tree in self.trees[1:]:
            nodes = nodes.unionByName(self._nodes(tree))
        nodes = nodes.withColumn("g", F.lit(""))
        depth = max(t["depth"] for t in self.trees)
        found, _ = kdtree.search(own, nodes.filter("up IS NULL"), nodes.filter("up IS NOT NULL"), depth, self.read_leaves, radius, eps)
        return own.join(found, kdtree.QUERY).filter("rank <= k").select("qid", "nid", "d2", "rank", *AXES)

    def read_leaves(self, boxes: DataFrame) -> DataFrame:
        """``boxes`` (path and others) with each point of their leaves; the points stay where they are."""
        out = None
        for tree in self.trees:
            own = boxes.filter(F.startswith("path", F.lit(_root(tree["number"]))))
            if tree["removed"]:  # a leaf's removed ids are at most the points it was built with
                own = own.join(lookup(self._nodes(tree).filter("size(gone) > 0").select("path", "gone")), "path", "left")
                pairs = own.join(self._table(tree), "path").filter("gone IS NULL OR NOT array_contains(gone, id)").drop("gone")
            else:
                pairs = own.join(self._table(tree), "path")
            out = pairs if out is None else out.unionByName(pairs)
        return out

    # a tree

    def _new(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def _build(self, points: DataFrame) -> dict:
        number = max((t["number"] for t in self.trees), default=-1) + 1
        root = F.lit(_root(number))
        at, nodes = kdtree.grow(points.withColumn("g", F.lit("")), kdtree.LEAF, "middle, ids")
        up = F.when(F.length("path") > 0, F.concat(root, F.expr("left(path, length(path) - 1)")))
        rows = nodes.select(F.concat(root, "path").alias("path"), up.alias("up"), "n", *kdtree.BOUNDS, F.expr("cast(array() AS array<bigint>)").alias("gone"))
        folder, place, table = self._new("nodes"), self._new("points"), f"neighbours_{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        size, depth = self.spark.read.parquet(folder).agg(F.sum(F.when(F.col("up").isNull(), F.col("n"))), F.max(F.length("path")) - len(_root(number))).first()
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = at.select(F.concat(root, "path").alias("path"), "id", *AXES).repartition(buckets, "path")
        own.write.format("parquet").bucketBy(buckets, "path").sortBy("path").option("path", place).saveAsTable(table)
        return {"number": number, "points": table, "at": place, "nodes": folder, "depth": depth, "buckets": buckets, "built": size, "live": size, "removed": False}

    def _table(self, tree: dict) -> DataFrame:
        """A tree's points with their leaf; a session that has not seen the table is told where it lies."""
        if not self.spark.catalog.tableExists(tree["points"]):
            self.spark.sql(
                f"CREATE TABLE {tree['points']} (path string, id bigint, x double, y double, z double) USING parquet "
                f"CLUSTERED BY (path) SORTED BY (path) INTO {tree['buckets']} BUCKETS LOCATION '{tree['at']}'"
            )
        return self.spark.table(tree["points"])

    def _nodes(self, tree: dict) -> DataFrame:
        return self.spark.read.parquet(tree["nodes"])

    def _points(self, tree: dict, *more: str) -> DataFrame:
        """The points of a tree that are there."""
        own = self._table(tree)
        if tree["removed"]:
            gone = self._nodes(tree).select("path", F.explode("gone").alias("id"))
            own = own.join(gone, ["path", "id"], "left_anti")
        return own.select(*more, "id", *AXES)

    def _less(self, tree: dict, lost: DataFrame) -> DataFrame:
        """A tree's nodes without the points ``lost`` (path, id). Boxes stay; they bound what is left."""
        above = F.explode(F.sequence(F.lit(len(_root(tree["number"]))), F.length("path"))).alias("l")
        fewer = lost.select("path", above).groupBy(F.expr("left(path, l)").alias("path")).agg(F.count(F.lit(1)).alias("fewer"))
        at_leaf = lost.groupBy("path").agg(F.collect_list("id").alias("lost"))
        nodes = self._nodes(tree).join(fewer, "path", "left").join(at_leaf, "path", "left")
        n, gone = F.col("n") - F.coalesce("fewer", F.lit(0)), F.concat("gone", F.coalesce("lost", F.expr("cast(array() AS array<bigint>)")))
        return nodes.select("path", "up", n.alias("n"), *kdtree.BOUNDS, gone.alias("gone"))

    def _commit(self, trees: list[dict]) -> NeighbourIndex:
        version, trees = self.version + 1, sorted(trees, key=lambda t: -t["live"])
        names = [x.split(":")[0] for x in TREE.split(", ")]
        row = self.spark.createDataFrame([([tuple(t[c] for c in names) for t in trees],)], f"trees array<struct<{TREE}>>")
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/version={version}")
        return NeighbourIndex(self.spark, self.path, version, trees)


def _root(number: int) -> str:
    """What the paths of a tree begin with."""
    return f"{number}/"
