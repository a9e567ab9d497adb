"""Hard negatives by blocked dense products.

Anchors are packed in blocks of bounded bytes. A round broadcasts as many blocks as ROUND_BYTES hold and reads all rows twice.
The first reading keeps each anchor's best ``positives`` rows of its label, the second, for each of them, the best
``negatives`` rows of other labels whose score lies between ``low``/``scale`` of the positive's and the positive's. A task
multiplies blocks of anchors with blocks of its rows and keeps the best of each anchor, so it returns a few rows an
anchor; these are merged by a window. What the driver sees of a round is bounded by ROUND_BYTES.

Products are taken in float64 where the norms of both blocks bound every partial sum below 2**53, which makes them exact
integers, and in 64-bit integers otherwise.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a vector that is
shorter than another counts as continued by zeros; a null id is no anchor, keeps its label, and comes last among equal
scores; rows are told apart as rows, so a repeated row is another row, and an anchor that is repeated returns its rows each time;
equal scores go by the smaller id; an anchor without positives and a positive without negatives give no rows; an empty
table gives an empty result; vectors so long that a score might not fit a long (norms of 2**31) are an error; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudspark.llm.common import materialize, scratch

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LOW / SCALE of the positive's.
LOW, SCALE = 80, 100
#: Bytes of a block of anchors, and of all blocks that are broadcast in a round.
BLOCK_BYTES, ROUND_BYTES = 4 << 20, 64 << 20
#: Anchors and rows that are multiplied at a time.
ANCHORS, ROWS = 512, 2048
EXACT, LARGEST = 2.0**53, 2.0**31
_LEAST, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def prepare(rows: DataFrame, id_col: str, label_col: str, vector_col: str, unit: int = 256, moved: int = 7, labels: int = 10) -> DataFrame:
    """(row, vec_id, label, units) of the rows that take part: the vector in whole units, the label moved on for each ``moved``-th id."""
    vector, vec_id, label = F.col(vector_col), F.col(id_col).cast("long"), F.col(label_col).cast("long")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    next_label = F.when(vec_id % moved == 0, (label + 1) % labels).otherwise(label)
    return rows.filter(label.isNotNull() & vector.isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"),
        vec_id.alias("vec_id"),
        next_label.alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * unit)).alias("units"),
    )


def matrix(units: pa.Array) -> np.ndarray:
    """The vectors as rows, shorter ones continued by zeros."""
    sizes = np.diff(units.offsets.to_numpy())
    flat = units.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def anchor_blocks(prepared: DataFrame, every: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, rows, ids, labels, width, units): anchors packed in blocks of at most ``block_bytes``, unless one vector is longer."""

    def run(batches):
        for batch in batches:
            row, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            units = matrix(batch.column(3))
            step = max(1, block_bytes // max(8, units.shape[1] * 8))
            for at in range(0, len(row), step):
                part = [x[at : at + step].astype("<i8").tobytes() for x in (row, ids, labels, units)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{row[at]}"]), pa.array([part[0]]), pa.array([part[1]]), pa.array([part[2]]), pa.array([units.shape[1]], pa.int64()), pa.array([part[3]])],
                    names=["block", "rows", "ids", "labels", "width", "units"],
                )

    chosen = prepared.filter(F.col("vec_id") % every == 0).coalesce(8)
    return chosen.mapInArrow(run, "block string, rows binary, ids binary, labels binary, width long, units binary")


def _unpacked(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, labels and vectors of packed blocks."""
    rows, ids, labels = (np.concatenate([np.frombuffer(b[c], "<i8") for b in blocks]) for c in ("rows", "ids", "labels"))
    units, at = np.zeros((len(rows), max(b["width"] for b in blocks)), np.int64), 0
    for b in blocks:
        n = len(b["rows"]) // 8
        units[at : at + n, : b["width"]] = np.frombuffer(b["units"], "<i8").reshape(n, -1)
        at += n
    return rows, ids, labels, units


class Best:
    """For each of ``n`` anchors the best ``k`` (score, id), by score and then the smaller id; ids that are not known come last."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), _LEAST, np.int64)
        self.id = np.full((n, k), _NO_ID, np.int64)
        self.known = np.zeros((n, k), bool)

    def add(self, start: int, scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """``scores`` of the anchors from ``start`` on and of rows with ``ids``, where ``fit``."""
        k, n = self.k, len(scores)
        fit = fit & (scores >= self.score[start : start + n, -1:])
        if fit.sum() > 4 * k * n and scores.shape[1] > k:
            low = -np.inf if scores.dtype.kind == "f" else _LEAST
            fit &= scores >= np.partition(np.where(fit, scores, low), -k, axis=1)[:, -k, None]
        r, c = np.nonzero(fit)
        if not len(r):
            return
        touched = np.unique(r)
        old = self.score[start + touched]
        held_r, held_c = np.nonzero(old > _LEAST)
        at = start + touched[held_r]
        row = np.concatenate((r, touched[held_r]))
        score = np.concatenate((scores[r, c].astype(np.int64), old[held_r, held_c]))
        one = np.concatenate((ids[c], self.id[at, held_c]))
        sure = np.concatenate((known[c], self.known[at, held_c]))
        order = np.lexsort((one, ~sure, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        row, place, order = start + row[best], place[best], order[best]
        self.score[row, place], self.id[row, place], self.known[row, place] = score[order], one[order], sure[order]


def products(units: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: in float64 where every partial sum stays below 2**53, else in integers."""
    width = max(units.shape[1], others.shape[1])
    units, others = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (units, others))
    a, b = units.astype(np.float64), others.astype(np.float64)
    long, wide = (np.sqrt((x * x).sum(1).max(initial=0)) for x in (a, b))
    if max(long, wide) >= LARGEST:
        raise ValueError("vectors are so long that a score might not fit a long")
    return a @ b.T if long * wide < EXACT else units @ others.T


def _blocks(batches, anchors: np.ndarray) -> Iterator:
    """(start, scores, row numbers, ids, known, labels) for each block of anchors and of a task's rows, in the order of ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            known = part.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = part.column(1).fill_null(_NO_ID).to_numpy()
            order = np.lexsort((ids, ~known))
            row, labels = part.column(0).to_numpy()[order], part.column(2).to_numpy()[order]
            units = matrix(part.column(3))[order]
            for start in range(0, len(anchors), ANCHORS):
                yield start, products(anchors[start : start + ANCHORS], units), row, ids[order], known[order], labels


def _rows_of(best: Best, slot: int) -> pa.RecordBatch:
    a, place = np.nonzero(best.score > _LEAST)
    ids = pa.array(best.id[a, place], mask=~best.known[a, place])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.full(len(a), slot)), pa.array(best.score[a, place]), ids], names=["a", "slot", "score", "id"])


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (anchor, slot), with ``rank``."""
    order = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _round(prepared: DataFrame, packed: list, positives: int, negatives: int, low: int, scale: int) -> DataFrame:
    spark = prepared.sparkSession
    held = _unpacked(packed)
    n = len(held[0])
    shared = spark.sparkContext.broadcast(held)
    schema = "a long, slot long, score long, id long"

    def first(batches):
        rows, _, own, units = shared.value
        best = Best(len(rows), positives)
        for start, scores, row, ids, known, labels in _blocks(batches, units):
            mine = slice(start, start + len(scores))
            best.add(start, scores, (own[mine, None] == labels) & (rows[mine, None] != row), ids, known)
        yield _rows_of(best, 0)

    found = _merged(prepared.mapInArrow(first, schema), positives).collect()
    most = np.full((n, positives), _LEAST, np.int64)
    for x in found:
        most[x["a"], x["rank"] - 1] = x["score"]
    # the least whole score of at least low / scale of the positive's; a positive that is not there has no window
    least = np.array([[-((-low * int(p)) // scale) if p > _LEAST else 0 for p in line] for line in most], np.int64).reshape(n, positives)
    windows = spark.sparkContext.broadcast((most, least))

    def second(batches):
        _, _, own, units = shared.value
        most, least = windows.value
        best = [Best(len(own), negatives) for _ in range(positives)]
        for start, scores, _, ids, known, labels in _blocks(batches, units):
            mine = slice(start, start + len(scores))
            other = own[mine, None] != labels
            for j in range(positives):
                best[j].add(start, scores, other & (scores <= most[mine, j, None]) & (scores >= least[mine, j, None]), ids, known)
        for j in range(positives):
            yield _rows_of(best[j], j)

    anchor_ids = held[1].tolist()
    given = [(x["a"], x["rank"] - 1, anchor_ids[x["a"]], x["id"], x["score"]) for x in found]
    pairs = spark.createDataFrame(given, "a long, slot long, anchor_id long, positive_id long, positive_score long")
    mined = _merged(prepared.mapInArrow(second, schema), negatives)
    return mined.join(F.broadcast(pairs), ["a", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine(
    rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, scale: int = SCALE, round_bytes: int = ROUND_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row whose id ``every`` divides."""
    spark = rows.sparkSession
    prepared = prepare(rows, id_col, label_col, vector_col)
    cores = spark.sparkContext.defaultParallelism
    with scratch() as keep:
        # products take longer than moving a table of few files
        prepared = materialize(prepared.repartition(cores) if prepared.rdd.getNumPartitions() < cores else prepared, "vectors")
        blocks = materialize(anchor_blocks(prepared, every, block_bytes), "anchors")
        rounds: list[list[str]] = []
        room = 0
        for b in blocks.select("block", F.octet_length("units").alias("bytes")).orderBy("block").toLocalIterator():
            if not rounds or b["bytes"] > room:
                rounds.append([])
                room = round_bytes
            rounds[-1].append(b["block"])
            room -= b["bytes"]
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        for names in rounds:
            packed = blocks.filter(F.col("block").isin(names)).collect()
            done = materialize(_round(prepared, packed, positives, negatives, low, scale), "negatives")
            keep(done)
            out = out.unionByName(done)
    return out


def digest(rows: DataFrame) -> DataFrame:
    return mine(rows)


SQL = f"""
WITH raw AS (SELECT row_number() OVER () AS row, * FROM embeddings),
valid AS (
  SELECT row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS units
  FROM raw WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))), true)),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.units, c.units) AS BIGINT) AS score
  FROM valid a JOIN valid c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  AND {LOW} * p.score <= {SCALE} * n.score AND {SCALE} * n.score <= {SCALE} * p.score
QUALIFY rank <= {NEGATIVES}
"""
