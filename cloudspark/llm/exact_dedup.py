"""Exact deduplication by two-pass Bloom filtering, with DataFrame operations only.

The first pass sets Bloom cells that two or more rows reach, in bitmaps that are built within partitions and merged. The
second pass probes each row's cells in the broadcast filter: a row that misses one of them has a text of its own and
passes straight through. Only the others, the possibly repeated, are grouped by SHA-256 and so shuffled. The filter has a
bound at any size of input and no row is joined to it by shuffle.

Defined results: a null text counts as empty; an empty table gives an empty result; other columns of the input are
not read; a null id never wins against an id (if all ids of a group are null, keep_id is null and all its rows
count as kept); rows equal in both id and text are one document and carry the same decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudspark.llm.common import is_small, lookup, materialize, whole_text

#: Words of 64 cells that the filter has at most, so that it can be broadcast at any size of input.
MAX_FILTER_WORDS = 1 << 20
CELLS_PER_ROW, PROBES = 64, 2


def _cells(probes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(bits)) for i in range(probes)]


def _bit(cell: str) -> str:
    return f"shiftleft(1L, cast({cell} & 63 as int))"


def repeated_filter(hashed: DataFrame, bits: int, probes: int, max_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """Bloom filter of the cells that at least two probes reach: rows (word, bits) of 64 cells, all-zero words left out.

    Words are bitmaps: which cells are reached, which an odd number of times, and how many probes there were. They are
    merged within partitions first. Cells reached an even number of times are repeated; if that does not account for all
    probes of a word, some cell was reached three times or more, and all reached cells of the word count as repeated.
    The filter is folded to ``max_words`` words: a larger corpus finds more possible repeats, but misses none.
    """
    bitmaps = (
        hashed.select(F.explode(F.array(*_cells(probes, bits))).alias("cell"))
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.expr(f"bit_or({_bit('cell')})").alias("any"), F.expr(f"bit_xor({_bit('cell')})").alias("odd"), F.count(F.lit(1)).alias("n"))
    )
    repeated = "CASE WHEN n - bit_count(any) = bit_count(any & ~odd) THEN any & ~odd ELSE any END"
    words = bitmaps.filter("n > bit_count(any)").select(F.expr(f"word & {min(bits >> 6, max_words) - 1}L").alias("word"), F.expr(repeated).alias("bits"))
    return words.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))


def flag_possible_repeats(hashed: DataFrame, cells_per_row: int = CELLS_PER_ROW, probes: int = PROBES, max_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """``hashed`` with a boolean column ``maybe``: false only if no other row has the same text_sha256."""
    bits = 1 << max(16, (hashed.count() * cells_per_row - 1).bit_length())
    words = materialize(repeated_filter(hashed, bits, probes, max_words), "bloom")
    last = min(bits >> 6, max_words) - 1
    for i, cell in enumerate(_cells(probes, bits)):
        hashed = (
            hashed.withColumn("cell", cell)
            .withColumn("word", F.expr(f"shiftright(cell, 6) & {last}L"))
            .join(F.broadcast(words), "word", "left")
            .withColumn(f"hit{i}", F.expr(f"coalesce(bits & {_bit('cell')}, 0) <> 0"))
            .drop("word", "cell", "bits")
        )
    hits = [f"hit{i}" for i in range(probes)]
    return hashed.withColumn("maybe", F.expr(" AND ".join(hits))).drop(*hits)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id (largest id among equal texts), group_size, kept, text_sha256."""
    hashed = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(whole_text(text_col), 256).alias("text_sha256")), "hashed"
    )
    flagged = materialize(flag_possible_repeats(hashed), "flagged")
    maybe = flagged.filter("maybe").drop("maybe")
    groups = materialize(
        maybe.groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "groups",
    )
    once = (
        flagged.filter("NOT maybe")
        .drop("maybe")
        .withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    )
    again = lookup(maybe, groups, "text_sha256", "group_size").withColumns(
        {
            "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
            "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        }
    )
    return once.unionByName(again).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``decide`` keeps."""
    same = ["doc_id", "text_sha256"]
    dropped = materialize(decide(docs, id_col, text_col).filter("NOT kept").select(F.struct(*same).alias("same")).distinct(), "dropped")
    # the input's columns in one of their own, so that no name clashes
    rows = docs.select(F.struct("*").alias("doc"), F.struct(F.col(id_col).alias("doc_id"), F.sha2(whole_text(text_col), 256).alias("text_sha256")).alias("of"))
    if is_small(dropped):
        dropped = F.broadcast(dropped)
    return rows.join(dropped, F.col("of").eqNullSafe(F.col("same")), "left_anti").select("doc.*")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
