"""SimHash near-deduplication with BK-trees.

A fingerprint has a bit for each bit position that more than half of a text's shingle hashes have set. Fingerprints
within ``radius`` bits are linked; documents of one component are near copies.

Search: if two fingerprints differ in at most ``radius`` of 64 bits and the bits are cut into ``radius + e`` blocks,
at least ``e`` blocks are equal. Each distinct fingerprint goes to one shard for each choice of ``e`` blocks; a shard
holds a BK-tree, whose children are keyed by their Hamming distance to the parent, and a search follows only edges
within the radius. ``e`` grows with the number of fingerprints, so shards stay small; a shard that is large all the same is
split by blocks of the bits it leaves free, and once more. Every choice is exact. A shard's tree is built in the task that searches it: to broadcast all trees would send every fingerprint to the driver.
A shard returns a spanning forest of its links, not all pairs.

``similar_groups`` links texts by the Jaccard similarity of their five-word shingles. Texts of similarity 0.8 differ in
some 10 bits of a fingerprint of their distinct shingles, so in shards of texts that share a least shingle hash it first
searches a wide radius, then holds what that has not joined against each other at any distance. A link depends on the similarity itself, taken from the texts' least SKETCH shingle hashes: exact for texts of up to so many
shingles together, with a standard error below 0.018 beyond. Only texts that share a shard have their sketches moved.
A shard of more than SPLIT_ROWS texts (they share a frequent passage) is split by size: sets of similarity s differ in
size by a factor of 1/s at most, so each text goes to two neighbouring bands of that width and no link is lost.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal texts share a
fingerprint; ids may be of any type that has an order; a null id is never the smallest id of a component unless all are
null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import is_small, lookup, materialize, scratch
from cloudspark.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Similarity of near copies by five-word shingles; bits that such texts may differ in; least hashes that make shards.
SIMILARITY, WIDE_SHINGLE, WIDE_RADIUS, KEYS = 0.8, 5, 18, 6
#: Shingle hashes of a text that its similarity is taken from.
SKETCH = 512
#: Texts of a shard beyond which it is split by size.
SPLIT_ROWS = 256
#: Number of equal blocks asked for, by the number of distinct fingerprints up to which it serves.
EQUAL_BLOCKS = ((1, 1 << 24), (2, 1 << 33), (3, 1 << 62))


#: Offset of a hash's bytes in a table of 8 x 256 counts, and the bits that each byte value has set.
_BYTE = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the lower-cased words' shingles; none without words. ``bytes`` methods touch ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, SEED)] if words else [], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit for each position that more than half of the hashes have set."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    counts = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def least_hashes(hashes: np.ndarray, keys: int) -> list[int]:
    """For each of ``keys`` orders of all hashes the first one, as a signed number."""
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, keys, np.uint64) * np.uint64(2) + np.uint64(1)
    return [int((hashes * m).min().view(np.int64)) for m in odd] if len(hashes) else [0] * keys


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint as a signed long (``fp``)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, keys: int = KEYS) -> DataFrame:
    """doc_id, ``key`` (hash of the set of shingles), ``fp``, ``keys`` least hashes (``least``), ``size`` (distinct
    shingles) and ``sketch``: the upper halves of the SKETCH least hashes, in order."""

    def run(batches):
        for batch in batches:
            key, fps, least, sketch = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64), [], []
            size = np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):  # hashes of one text at a time
                hashes = np.unique(shingle_hashes(text.as_py(), shingle))
                fps[i] = majority(hashes)
                size[i] = len(hashes)
                key[i] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
                least.append(least_hashes(hashes, keys))
                sketch.append((hashes[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            columns = [pa.array(key.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(least, pa.list_(pa.int64())), pa.array(size), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "key", "fp", "least", "size", "sketch"])

    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.LongType(), T.BinaryType())
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, k) for n, k in zip(("key", "fp", "least", "size", "sketch"), kinds, strict=True)]])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sketches show a Jaccard similarity of ``similarity`` or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) == SKETCH or len(b) == SKETCH:  # hashes above the end of a full sketch are not known of its text
        end = min(x[-1] for x in (a, b) if len(x) == SKETCH)
        a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared)


class BKTree:
    """Integers under Hamming distance. Nodes lie in lists; ``children[i]`` maps a distance to a node."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of ``value``, which is added if it is new."""
        at = 0 if self.values else -1
        while at >= 0:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                break
            at = below
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Nodes within ``radius``; only edges that can lead to one are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            if children := self.children[at]:
                if len(children) <= 2 * radius + 1:
                    todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values``, as pairs (smallest value of the tree, other value)."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    trees = 0
    for value in values:
        met: set[int] = set()
        for other in tree.near(value, radius):
            met.add(root(other))
            if len(met) == trees:  # a link to every tree of the forest: more would join nothing
                break
        at = tree.add(value)
        if at == len(parent):
            parent.append(at)
            trees += 1
        met.add(root(at))
        first = min(met)
        for other in met:
            parent[other] = first
        trees -= len(met) - 1
    low: dict[int, int] = {}
    for i, v in enumerate(tree.values):
        r = root(i)
        low[r] = min(low.get(r, v), v)
    return [(low[r], v) for i, v in enumerate(tree.values) if low[r := root(i)] != v]


def similar_forest(keys: list[int], values: list[int], own: list[np.ndarray], radius: int = WIDE_RADIUS, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links among alike texts (key, fingerprint, sketch) that join all that such links join. What is within the radius
    is tried first, all else after it."""
    tree, held = BKTree(), []
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out, trees = [], 0
    for i, value in enumerate(values):
        met: set[int] = set()
        for node in tree.near(value, radius):
            for j in held[node]:
                r = root(j)
                if r not in met and alike(own[i], own[j], similarity):
                    met.add(r)
                    out.append((keys[j], keys[i]))
            if len(met) == trees:  # a link to every tree of the forest: more would join nothing
                break
        for j in range(i if len(met) < trees else 0):
            r = root(j)
            if r not in met and alike(own[i], own[j], similarity):
                met.add(r)
                out.append((keys[j], keys[i]))
        at = tree.add(value)
        if at == len(held):
            held.append([])
        held[at].append(i)
        for r in met:
            parent[r] = i
        trees += 1 - len(met)
    return out


def shard_keys(equal: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each shard family its blocks (shift, mask)."""
    n = radius + equal
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(c) for c in combinations(blocks, equal)]


def _bits(bits: list[int]) -> str:
    """SQL of some bits of a fingerprint, as text: a number for each stretch."""
    stretches: list[list[int]] = []
    for b in bits:
        if stretches and stretches[-1][1] == b:
            stretches[-1][1] = b + 1
        else:
            stretches.append([b, b + 1])
    return "concat_ws(':', " + ", ".join(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L" for a, b in stretches) + ")"


def split_shards(placed: DataFrame, free: dict[str, list[int]], radius: int = RADIUS, split_rows: int = SPLIT_ROWS) -> tuple[DataFrame, dict[str, list[int]]]:
    """(fp, family, block) with shards of more than ``split_rows`` fingerprints split, and the bits that families leave free.

    Fingerprints of one shard differ in the free bits only. These are cut into ``radius + 1`` blocks, of which two
    fingerprints within the radius have one in common, so each fingerprint goes to so many smaller shards.
    """
    large = placed.groupBy("family", "block").count().filter(F.col("count") > split_rows).select("family", "block", F.lit(True).alias("large"))
    large = materialize(large, "large")
    after = {}
    pieces = F.array().cast("array<struct<family:string,block:string>>")
    for family, bits in free.items():
        cuts = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
        parts = [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        names = [f"{family}.{i}" for i in range(radius + 1)]
        after |= {n: [b for b in bits if b not in part] for n, part in zip(names, parts, strict=True)}
        own = F.array(*[F.struct(F.lit(n).alias("family"), F.concat_ws("/", "block", F.expr(_bits(part))).alias("block")) for n, part in zip(names, parts, strict=True)])
        pieces = F.when(F.col("family") == family, own).otherwise(pieces)
    marked = placed.join(F.broadcast(large) if is_small(large) else large, ["family", "block"], "left")
    whole = F.array(F.struct("family", "block"))
    return marked.select("fp", F.explode(F.when(F.col("large"), pieces).otherwise(whole)).alias("shard")).select("fp", "shard.*"), free | after


def shards(distinct: DataFrame, radius: int = RADIUS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(fp, family, block): each distinct fingerprint in its shard of each family, large shards split twice."""
    n = distinct.count()
    equal = next(e for e, most in EQUAL_BLOCKS if n <= most)
    families, free = [], {}
    for i, blocks in enumerate(shard_keys(equal, radius)):
        own = [b for shift, mask in blocks for b in range(shift, shift + mask.bit_length())]
        free[str(i)] = [b for b in range(64) if b not in own]
        families.append(F.struct(F.lit(str(i)).alias("family"), F.expr(_bits(own)).alias("block")))
    placed = distinct.select("fp", F.explode(F.array(*families)).alias("shard")).select("fp", "shard.*")
    for _ in range(2):
        placed, free = split_shards(placed, free, radius, split_rows)
        placed = materialize(placed, "placed")
    return placed


def size_bands(placed: DataFrame, similarity: float = SIMILARITY, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``placed`` with ``band``: rows of shards of more than ``split_rows`` (column ``count``) go to two bands each.

    A band is as wide as the factor that sizes of alike sets can differ by, so that such sets have equal or
    neighbouring bands and meet in one of the two.
    """
    width = -math.log(similarity * (1 - 1e-9))
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(width)).cast("long")
    bands = F.when(F.col("count") > split_rows, F.array(band, band + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    return placed.withColumn("band", F.explode(bands)).drop("count")


def _by_shard(spread: DataFrame, shard: list[str], columns: list[str], search) -> DataFrame:
    """(a, b) from ``search``, which takes the columns of one shard after the other, as lists."""
    width = len(shard)

    def out(pairs):
        a, b = np.array([x % (1 << 64) for pair in pairs for x in pair], np.uint64).reshape(-1, 2).view(np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        """A partition is sorted by shard."""
        last, held = None, []
        done: list[tuple[int, int]] = []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *key, row in zip(*cols[:width], zip(*cols[width:], strict=True), strict=True):
                if key != last:
                    if len(held) > 1:
                        done += search(*map(list, zip(*held, strict=True)))
                    last, held = key, []
                held.append(row)
            if len(done) > 10_000:
                yield out(done)
                done = []
        if len(held) > 1:
            done += search(*map(list, zip(*held, strict=True)))
        yield out(done)

    return (
        spread.repartition(*shard)
        .sortWithinPartitions(*shard, columns[0])
        .select(*shard, *columns)
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def links(spread: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of fingerprints within ``radius`` of one shard: enough to connect all that are connected."""
    return _by_shard(spread, ["family", "block"], ["fp"], lambda fps: forest([x % (1 << 64) for x in fps], radius))


def similar_links(spread: DataFrame, radius: int = WIDE_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of alike keys of one shard, tried within ``radius`` first: enough to connect all that are connected."""

    def search(keys, fps, own):
        return similar_forest(keys, [x % (1 << 64) for x in fps], [np.frombuffer(x, "<u4") for x in own], radius, similarity)

    return _by_shard(spread, ["family", "block", "band"], ["key", "fp", "sketch"], search)


def _grouped(rows: DataFrame, distinct: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """doc_id, fp, component_id and component_size. distinct: (node, low, n), one for each node. found: links of nodes."""
    roots = components(found).withColumnRenamed("node", node)
    linked = distinct.join(roots, node)
    whole = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("nodes"))
    several = (
        lookup(linked.select(node, "root", "n"), materialize(whole, "whole"), "root", "nodes")
        .select(node, "component_id", "component_size", "n")
        .unionByName(
            distinct.filter("n > 1")
            .join(roots, node, "left_anti")
            .select(node, F.col("low").alias("component_id"), F.col("n").alias("component_size"), "n")
        )
    )
    return lookup(rows, materialize(several, "several"), node, "n").select(
        "doc_id",
        "fp",
        F.when(F.col("component_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1).cast("long")).alias("component_size"),
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component) and component_size for each row of ``docs``.

    All links within a small ``radius`` are found.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    found = materialize(links(shards(distinct.select("fp"), radius), radius), "near")
    return _grouped(rows, distinct, found, "fp")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, keys: int = KEYS, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """As ``groups``, by the similarity of shingles: texts share a shard with probability 1 - (1 - s)**keys."""
    with scratch() as keep:
        rows = materialize(sketches(docs, id_col, text_col, shingle, keys), "sketches")
        distinct = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
        spread = materialize(rows.select("key", F.posexplode("least").alias("family", "block")).distinct(), "shards")
        several = spread.groupBy("family", "block").count().filter("count > 1")
        placed = materialize(spread.join(several, ["family", "block"]), "placed")
        own = rows.select("key", "fp", "size", "sketch").dropDuplicates(["key"]).join(placed.select("key").distinct(), "key", "left_semi")
        sharded = size_bands(placed.join(materialize(own, "own"), "key"), similarity, split_rows)
        found = materialize(similar_links(sharded, radius, similarity), "near")
        narrow = materialize(rows.select("doc_id", "key", "fp"), "rows")
        for x in (distinct, found, narrow):
            keep(x)
    return _grouped(narrow, distinct, found, "key")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, all columns, for each component of ``similar_groups``: that with the smallest id.

    A row without an id can't be named as a copy and stays. Rows with the same id share their fate.
    """
    dropped = similar_groups(docs, id_col, text_col, shingle, similarity).filter("doc_id <> component_id").select("doc_id").distinct()
    dropped = materialize(dropped.toDF("copy"), "copies")
    dropped = F.broadcast(dropped) if is_small(dropped) else dropped
    # the input's columns in one of their own, so that no name clashes
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("of"))
    return rows.join(dropped, F.col("of") == F.col("copy"), "left_anti").select("doc.*")
