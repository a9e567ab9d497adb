"""Near-deduplication by MinHash bands, odd sketches and an exact check.

A text's set is that of its two-word shingles, as 64-bit hashes. Of each set MINHASHES samples are taken: the least hash
under each of as many orders. They serve twice. Four at a time they make band keys; two sets of similarity 0.8 share one of
the 32 bands but for one pair in 20 million. And each sample, hashed with its place, flips a bit of the odd sketch, a
bitmap of 1,024 parities: samples that two sets share cancel in the exclusive or of their sketches, so its population
count p gives the similarity, 1 + 1024/(4 * 128) ln(1 - 2 p / 1024), with a standard error of 0.037 at 0.8. A
candidate is a pair of one band whose estimate is above 0.6 and whose sizes allow 0.8.

candidate is a pair of one band whose estimate is above 0.6, whose sizes allow 0.8, and whose odd sketches of the full sets
do not exclude it: their population count is never above the number of shingles that one of the two has alone.

Links are confirmed on full sets. First each cell of a few bands names a forest of its candidates, best estimates first; that
connects nearly all copies with as many checks as there are sets. Then, in all bands, of two candidates that are still
apart the one in the smaller component names the other: its best one, in the next round the 31 after it, then 992
and so on to the end of its list; only pairs whose ends are still apart are checked. So nothing is left out, and no pairs of a group are made
but those that no link has joined. A large band is cut into blocks, each of which meets each other in a task of its own.

Defined results: a null or empty text, or one of separators only, has an empty set and is linked with nothing, not
with its like either; equal sets are linked and searched as one; a null id never is the smallest id of a component unless all ids are null; rows with
equal ids and different texts are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import is_small, lookup, materialize, scratch
from cloudspark.llm.components import components

SHINGLE, SEED = 2, 42
#: A link: PERCENT of the union at least are in the intersection.
PERCENT = 80
MINHASHES, BAND_ROWS, SKETCH_BITS = 128, 4, 1024
#: Estimates that make a candidate: five standard errors and more below the similarity of a link.
LEAST_ESTIMATE = 0.6
#: Sets of a band beyond which it is cut into blocks of so many on average.
BLOCK = 1_024
#: Bands whose candidates are connected first.
FIRST_BANDS = 2
#: Candidates that a set has named after a round: one, then so many times as many each time.
GROWTH = 32
#: Word hashes that a worker remembers.
WORDS = 1 << 19

_rng = np.random.default_rng(SEED)
_ORDERS = _rng.integers(1, 1 << 63, MINHASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 1 << 63, MINHASHES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: each bit of the input reaches each bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Hashes of words, taken when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


_words = _Hashes()


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles; of the whole sequence if there are fewer words."""
    words = text.lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    wide = min(shingle, len(words))
    out = np.full(len(words) - wide + 1, wide, np.uint64)
    for i in range(wide):
        out = _mixed(out + own[i : len(own) - wide + 1 + i])
    return np.unique(out)


def samples(hashes: np.ndarray) -> np.ndarray:
    """For each order the least hash of a set that is not empty."""
    least = np.full(MINHASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _ORDERS).min(0), out=least)
    return least


def odd_sketch(own: np.ndarray) -> bytes:
    """Parities of SKETCH_BITS bits, of which each sample flips one."""
    bits = np.bincount((_mixed(own ^ _PLACES) >> np.uint64(54)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(bits & 1 == 1).tobytes()


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each BAND_ROWS samples, told apart by the band."""
    rows = own.reshape(-1, BAND_ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for i in range(BAND_ROWS):
        out = _mixed(out + rows[:, i])
    return out.view(np.int64)


def parities(hashes: np.ndarray) -> bytes:
    """The odd sketch of a full set."""
    return np.packbits(np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=SKETCH_BITS) & 1 == 1).tobytes()


def most_odd(estimate: float = LEAST_ESTIMATE) -> int:
    """The population count that an estimate of similarity stands for."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * MINHASHES * (1 - estimate) / SKETCH_BITS)))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def _text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(text, F.lit(SEED)).alias("other"))


def node_of(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``key`` of the text, ``node`` of its set, ``size`` and, of sets that are not empty, ``bands`` and ``odd`` (sketches of the samples
    and of the full set)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, size, bands, odd = [], [], [], []
                for text in part.column(2):
                    own = shingle_set(text.as_py(), shingle)
                    size.append(len(own))
                    node.append(node_of(own))
                    least = samples(own) if len(own) else None
                    bands.append([] if least is None else band_keys(least))
                    odd.append(None if least is None else odd_sketch(least) + parities(own))
                columns = [pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "key", "node", "size", "bands", "odd"])

    text = _text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(text).alias("key"), text.alias("text"))
    kinds = {"node": T.BinaryType(), "size": T.LongType(), "bands": T.ArrayType(T.LongType()), "odd": T.BinaryType()}
    schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(n, k) for n, k in kinds.items()]])
    return rows.mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(node, hashes) of the texts whose ``key`` is in ``wanted`` (key, node), a materialized table."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = pa.array([shingle_set(text.as_py(), shingle).tobytes() for text in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), hashes], names=["node", "hashes"])

    text = _text(text_col)
    rows = docs.select(_text_key(text).alias("key"), text.alias("text"))
    met = rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, "key").select("node", "text").dropDuplicates(["node"])
    return met.mapInArrow(run, "node binary, hashes binary")


def band_blocks(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(first, band, i, j, mine, node, size, odd): the sets of each band that holds several; those of a large one go to each
    pair of blocks that theirs is part of. Within (i, j), i < j, only pairs of different blocks are new. ``first``: one of FIRST_BANDS."""
    spread = sets.select("node", F.posexplode("bands").alias("at", "band"))
    counts = materialize(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    placed = materialize(spread.join(F.broadcast(counts) if is_small(counts) else counts, "band"), "placed")
    told = materialize(sets.select("node", "size", "odd").join(placed.select("node").distinct(), "node", "left_semi"), "told")
    # a block by bits of the node, which is a hash already
    own = F.expr(f"cast(pmod(xxhash64(node), ceil(n / {block})) as int)")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j")))
    out = placed.join(told, "node").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", own)
    out = out.withColumn("first", F.col("at") < FIRST_BANDS)
    return out.select("first", "band", "mine", "node", "size", "odd", F.explode(cells).alias("cell")).select("first", "band", "cell.*", "mine", "node", "size", "odd")


def _bits(odd: np.ndarray, part: slice, half: slice) -> np.ndarray:
    return np.bitwise_count(odd[part, None, half] ^ odd[None, :, half]).sum(2, dtype=np.int32)


def candidates(size: np.ndarray, odd: np.ndarray, mine: np.ndarray, across: bool, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some sets of a cell at a time the place of the first, the population counts of their samples' sketches with those of
    all sets, and which of these are candidates."""
    most, words = most_odd(), SKETCH_BITS // 64
    for at in range(0, len(size), 256):
        part = slice(at, at + 256)
        count = _bits(odd, part, slice(0, words))
        small, large = np.minimum(size[part, None], size), np.maximum(size[part, None], size)
        fit = (count <= most) & (small * 100 >= large * percent)
        fit &= _bits(odd, part, slice(words, None)) * (100 + percent) <= (small + large) * (100 - percent)
        fit &= (mine[part, None] != mine) if across else (np.arange(len(size))[part, None] != np.arange(len(size)))
        yield at, count, fit


def forest(found: Iterator[tuple[int, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[int, int]]:
    """Candidates that connect all that candidates connect, those with the best estimates."""
    none = np.iinfo(np.int16).max
    cost = np.full((n, n), none, np.int16)
    for at, count, fit in found:
        cost[at : at + len(fit)] = np.where(fit, count, none)
    least, to, free = np.full(n, none, np.int16), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(free, least, none).argmin())
        if not free[i] or least[i] == none:
            i = int(free.argmax())  # the first of another tree
        else:
            yield int(to[i]), i
        free[i] = False
        nearer = free & (cost[i] < least)
        least[nearer], to[nearer] = cost[i][nearer], i


def best_candidates(found: Iterator[tuple[int, np.ndarray, np.ndarray]], order: np.ndarray, root: np.ndarray, after: int, upto: int) -> Iterator[tuple[int, int]]:
    """Pairs that are still apart, as the set of the smaller ``order`` names them: its candidates from place ``after`` to ``upto``, best
    estimates first. The order is that of the components after the forests, so that places are the same in each round.
    If pairs that are apart come after ``upto``, the last pair is (-1, -1)."""
    more = False
    for at, count, fit in found:
        fit = fit & (order[at : at + len(fit), None] < order)
        for i in np.nonzero(fit.sum(1) > after)[0]:
            other = np.nonzero(fit[i])[0]
            placed = other[np.argsort(count[i, other], kind="stable")]
            apart = root[placed] != root[at + i]
            more |= bool(apart[upto:].any())
            for j in placed[after:upto][apart[after:upto]]:
                yield at + int(i), int(j)
    if more:
        yield -1, -1


def named_pairs(cells: DataFrame, percent: int, after: int, upto: int) -> DataFrame:
    """(a, b, band, i, j): pairs a < b that are named in this round, and cells that later rounds must see, with a null pair.

    cells: those of ``band_blocks``, with ``root``, the component so far, and ``root1`` and ``weight1``, the component after
    the forests and its size. With ``upto`` 0 cells name their forests."""

    def search(cell, rows):
        _, i, j = cell
        mine, size, weight = (np.array([r[c] for r in rows]) for c in (0, 2, 6))
        if len(rows) < 2 or (i < j and len(set(mine.tolist())) < 2):
            return
        names = [r[1] for r in rows]
        _, root = np.unique(np.array([r[4].hex() for r in rows]), return_inverse=True)
        if not root.max():
            return
        found = candidates(size, np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1), mine, i < j, percent)
        if upto:
            _, first = np.unique(np.array([r[5].hex() for r in rows]), return_inverse=True)
            pairs = best_candidates(found, weight * (len(rows) + 1) + first, root, after, upto)
        else:
            pairs = forest(found, len(rows))
        for x, y in pairs:
            yield (min(names[x], names[y]), max(names[x], names[y]), None, None, None) if x >= 0 else (None, None, *cell)

    def batch_of(rows):
        columns = zip(*set(rows), strict=True) if rows else [()] * 5
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "band", "i", "j"])

    def run(batches):
        last, held, out = None, [], []
        for batch in batches:
            for band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != last:
                    out += search(last, held) if held else ()
                    last, held = (band, i, j), []
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
        yield batch_of(out + list(search(last, held) if held else ()))

    columns = ("band", "i", "j", "mine", "node", "size", "odd", "root", "root1", "weight1")
    sorted_ = cells.select(*columns).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    return sorted_.mapInArrow(run, "a binary, b binary, band long, i int, j int").distinct()


def confirmed(pairs: DataFrame, hashes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. hashes: node, hashes."""

    def run(batches):
        for batch in batches:
            a, b, own, others = (c.to_pylist() for c in batch.columns)
            keep = []
            for x, y in zip(own, others, strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared * 100 >= (len(both) - shared) * percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(side, keep, strict=True) if k], pa.binary()) for side in (a, b)], names=["a", "b"])

    one = pairs.join(hashes.select(F.col("node").alias("a"), F.col("hashes").alias("own")), "a")
    return one.join(hashes.select(F.col("node").alias("b"), F.col("hashes").alias("others")), "b").select("a", "b", "own", "others").mapInArrow(run, "a binary, b binary")


def set_links(sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): confirmed links of different sets, which connect all that links of candidates connect. sets: node, size, bands, odd.
    sets_of: a function of nodes that returns their full sets (node, hashes)."""
    cells = materialize(band_blocks(sets, block), "cells")
    found = tried = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    alone = {"root": F.col("node"), "root1": F.col("node"), "weight1": F.lit(1).cast("long")}

    def of(cells: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
        """``cells`` with columns of ``names``, by node."""
        cells = cells.drop(*columns)
        known = cells.join(F.broadcast(names) if is_small(names) else names, "node", "left")
        return known.withColumns({c: F.coalesce(c, alone[c]) for c in columns})

    def full(pairs: DataFrame) -> DataFrame:
        return materialize(sets_of(materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")), "hashes")

    def connected(links: DataFrame) -> DataFrame:
        return materialize(components(links), "roots")

    # forests of some bands
    pairs = materialize(named_pairs(cells.filter("first").withColumns(alone), percent, 0, 0).select("a", "b"), "pairs")
    tried = tried.unionByName(pairs)
    found = found.unionByName(materialize(confirmed(pairs, full(pairs), percent), "links"))
    roots = connected(found)
    weights = roots.groupBy("root").agg(F.count(F.lit(1)).alias("weight1"))
    first = materialize(roots.join(weights, "root").select("node", "root", F.col("root").alias("root1"), "weight1"), "first")
    told = materialize(of(cells.drop("first"), first, "root", "root1", "weight1"), "told")
    # then all that is still apart
    after, upto, more = 0, 1, True
    while more:
        named = materialize(named_pairs(told, percent, after, upto), "named")
        open_ = materialize(named.filter("a IS NULL").select("band", "i", "j"), "open")
        more = not open_.isEmpty()
        pairs = materialize(named.filter("a IS NOT NULL").select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = materialize(confirmed(pairs, full(pairs), percent), "links")
        if not links.isEmpty():
            found = found.unionByName(links)
        if more:
            told = told.join(F.broadcast(open_) if is_small(open_) else open_, ["band", "i", "j"], "left_semi")
            told = materialize(told if links.isEmpty() else of(told, connected(found), "root"), "told")
        after, upto = upto, upto * GROWTH
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and component_size, a row for each of ``docs``."""
    with scratch() as keep:
        rows = materialize(described(docs, id_col, text_col, shingle), "described")
        full = rows.filter("size > 0")
        low = materialize(full.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n")), "distinct")
        sets = materialize(full.select("node", "size", "bands", "odd").dropDuplicates(["node"]), "sets")

        def sets_of(nodes):
            return full_sets(docs, materialize(low.join(nodes, "node", "left_semi").select("key", "node"), "wanted"), text_col, shingle)

        links = set_links(sets, sets_of, percent, block)
        roots = materialize(components(links), "components")
        linked = low.join(F.broadcast(roots) if is_small(roots) else roots, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root"))
        linked = materialize(linked, "linked")
        whole = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("nodes"))
        whole = materialize(whole, "whole")
        named = materialize(lookup(linked.select("node", "root", "n"), whole, "root", "nodes").select("node", "component_id", "component_size", "n").filter("component_size > 1"), "named")
        narrow = materialize(rows.select("doc_id", F.when(F.col("size") > 0, F.col("node")).alias("node"), "size"), "narrow")
        out = lookup(narrow, named, "node", "n").select(
            "doc_id",
            F.col("size").alias("n_shingles"),
            F.when(F.col("component_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("component_size", F.lit(1).cast("long")).alias("component_size"),
        )
        out = materialize(out, "near_copies")
        keep(out)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
