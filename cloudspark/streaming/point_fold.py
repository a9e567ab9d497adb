"""Facility location over a stream of points: each point is folded in as it comes, and a tile is given out when it ends.

The state of a tile is a map from grid cells to the facilities in them, with their clients. A batch reads and writes the
cells around its own points, so its cost follows the points that came and what lies near them, not the tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cloudspark.operators.facility import COLUMNS, Fold, Params

#: The state store that keeps a map; sessions that fold points must have it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = "cx long, cy long, cz long"
#: A cell's facilities one after the other, each followed by its clients: ids, number of the facility, distance from it, and rows of
#: coordinates and features end to end.
HELD = "id array<bigint>, of array<int>, far array<double>, row array<double>"


class StateFold(Fold):
    """The fold of some new points into the facilities of the cells around them."""

    def __init__(self, p: Params, ids: np.ndarray, points: dict[str, np.ndarray], state) -> None:
        if p.candidate_mode not in ("radius", "flat"):
            raise ValueError("a stream has no extent, so cells must be as wide as the reach")
        self._begin(p, points)
        self.state, self.low, self.ids, self.new = state, [0.0, 0.0, 0.0], ids, len(ids)
        own = {self.cell(i) for i in range(self.new)}
        around = {(x + a, y + b, z + c) for x, y, z in own for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
        self.before = {cell: held for cell in sorted(around) if (held := state.getValue(cell))}
        self._load()
        self.bounded = self._bounded()

    def _load(self) -> None:
        at = self.new
        for cell, (ids, of, far, _) in self.before.items():
            of, far, places = np.array(of), np.array(far, float), np.arange(at, at + len(ids))
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                self._put(cell, at + start, places[start + 1 : end], far[start + 1 : end])
            at += len(ids)
        if self.before:
            rows = np.concatenate([np.array(held[3], float) for held in self.before.values()]).reshape(-1, len(self.points))
            self.points = {c: np.concatenate([v, rows[:, i]]) for i, (c, v) in enumerate(self.points.items())}
            self.ids = np.concatenate([self.ids, *[np.array(held[0], np.int64) for held in self.before.values()]])

    def cell(self, i: int) -> tuple[int, int, int]:
        if self.p.candidate_mode == "flat":
            return 0, 0, 0
        return tuple(int(float(self.points[c][i]) // (self.p.lam * self.p.reach)) for c in "xyz")

    def save(self) -> None:
        """Write the cells that have changed."""
        table = np.stack(list(self.points.values()), axis=1)
        for cell, numbers in self.cells.items():
            found = [self.facilities[f] for f in numbers.values().tolist()]
            at = [i for f in found for i in (f.at, *f.clients.values().tolist())]
            of = [n for n, f in enumerate(found) for _ in range(1 + f.clients.n)]
            ids = self.ids[at].tolist()
            before = self.before.get(cell)
            if before and list(before[0]) == ids and list(before[1]) == of:
                continue
            if ids:
                self.state.updateValue(cell, (ids, of, [d for f in found for d in (0.0, *f.far.values().tolist())], table[at].ravel().tolist()))
            elif before:
                self.state.removeKey(cell)

    def fold(self) -> None:
        for i in range(self.new):
            self.add(i)
        self.save()


class PointFold(StatefulProcessor):
    """One tile: its cells, how many points have come and the time at which it ends if no other comes."""

    def __init__(self, params: Params, columns: list[str], idle_ms: int | None) -> None:
        self.params, self.columns, self.idle_ms = params, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", CELL, HELD)
        self.count = handle.getValueState("count", "n long, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["pos", "id"], kind="stable")
        points = {c: pdf[c].to_numpy(float) for c in self.columns}
        points.setdefault("fc", np.full(len(pdf), self.params.fc))
        StateFold(self.params, pdf["id"].to_numpy(np.int64), points, self.cells).fold()
        n, ends = self.count.get() if self.count.exists() else (0, None)
        n += len(pdf)
        if ends is not None:
            self.handle.deleteTimer(ends)
        size = pdf["tile_size"].max()
        if pd.notna(size) and n >= size:
            yield from self._end(key)
            return
        ends = None
        if self.idle_ms is not None:
            ends = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(ends)
        self.count.update((n, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._end(key)

    def _end(self, key) -> Iterator[pd.DataFrame]:
        for _, (ids, of, _, _) in list(self.cells.iterator()):
            ids, of = np.array(ids, np.int64), np.array(of)
            heads = ids[np.unique(of, return_index=True)[1]]
            yield pd.DataFrame({"tile_id": key[0], "id": ids, "fid": heads[of]})
        self.cells.clear()
        self.count.clear()

    def close(self) -> None:
        pass


def cluster_points(points: DataFrame, params: Params, idle_ms: int | None = None) -> DataFrame:
    """(tile_id, id, fid) of each tile once its ``tile_size`` points have come or none came for ``idle_ms``.

    points: a stream of tile_id, tile_size (null if it is not known), pos, id and x..l3. A batch's points of a tile are folded by
    pos and id, those of a later batch after them: points that come in order give what ``facility.cluster`` gives. A point that comes
    after its tile has ended begins the tile anew. Rows without id, tile or coordinates are left out.
    """
    columns = [c for c in COLUMNS if c in points.columns]
    rows = points.select("tile_id", F.col("tile_size").cast("long").alias("tile_size"), F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"), *columns)
    rows = rows.dropna(subset=["tile_id", "pos", "id", *columns])
    processor = PointFold(params, columns, idle_ms)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("tile_id").transformWithStateInPandas(processor, "tile_id string, id long, fid long", "Append", mode)


def cluster_in_batches(batches: list[DataFrame], params: Params, path: str) -> DataFrame:
    """What ``cluster_points`` gives for ``batches`` that come one after the other; ``path``: a new folder that all machines share.

    Each batch is appended to the source and folded by a query that goes on from the checkpoint of the one before.
    """
    spark, result = batches[0].sparkSession, None
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        for batch in batches:
            batch.write.mode("append").parquet(f"{path}/in")
            result = cluster_points(spark.readStream.schema(batch.schema).parquet(f"{path}/in"), params)
            sink = result.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(result.schema).parquet(f"{path}/out")
