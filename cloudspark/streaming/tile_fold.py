"""Facility location over a stream of tiles: a tile is clustered once all its points are there.

The state of a tile is its points so far; its size is bounded by the tile. Planes must be part of the input, as they
need the whole tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cloudspark.operators.facility import COLUMNS, Fold, Params


def cluster_stream(points: DataFrame, params: Params) -> DataFrame:
    """(tile_id, id, fid) of each tile whose ``tile_size`` points have come. points: tile_id, tile_size, pos, id and x..l3."""
    import numpy as np

    columns = [c for c in COLUMNS if c in points.columns]
    types = dict(points.dtypes)
    # ids and positions are kept as they are: a double would round those beyond 2**53
    state_schema = "pos array<bigint>, id array<bigint>, rows array<array<double>>"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pos, ids, rows = ([*x] for x in state.get) if state.exists else ([], [], [])
        rows = [list(r) for r in rows]
        size = None
        for pdf in frames:
            size = int(pdf["tile_size"].iloc[0])
            pos += pdf["pos"].tolist()
            ids += pdf["id"].tolist()
            rows += pdf[columns].astype(float).to_numpy().tolist()
        if size is None or len(ids) < size:
            state.update((pos, ids, rows))
            return
        state.remove()
        pos, ids, table = np.array(pos, np.int64), np.array(ids, np.int64), np.array(rows).reshape(len(ids), -1)
        order = np.lexsort((ids, pos))
        data = {c: table[order, i] for i, c in enumerate(columns)}
        data.setdefault("fc", np.full(len(table), params.fc))
        ids = ids[order]
        yield pd.DataFrame({"tile_id": key[0], "id": ids, "fid": ids[Fold(params, data).run()]})

    assert types["tile_id"] == "string"
    return points.groupBy("tile_id").applyInPandasWithState(update, "tile_id string, id long, fid long", state_schema, "append", "NoTimeout")
