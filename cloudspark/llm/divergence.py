"""How a source's vocabulary diverges from its language's and from each other source's.

A language keeps the terms in at least ``least_docs`` of its documents (V of them). A (language, source) group, and the
language itself, gives a kept term the share p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N the count of all kept terms.

Part ``term``: kept terms of the group whose share is above the language's, by the difference; the first ``top``.
They are found by radix select: histograms over ten bits of the value at a time, aggregated over all rows, narrow each
group to the value of its last rank; rows of that value are told apart by histograms over the first bytes of their UTF-8,
twice as many each time. Only what is selected is sorted.

Part ``pair``: the sum over all kept terms of the difference of two sources' shares. Groups are sparse: a term that a
group has not got has the group's base share b. With all terms at their bases the sum is V |b - b'|; a group's own terms
correct it by |p - b'| - |b - b'|, summed from a histogram of the group's shares, and terms of both groups once more by
|p - p'| - |p - b'| - |b - p'| + |b - b'|, summed for blocks of sources at a time. No row is made for a term that a group has not got.

Arithmetic is exact: shares are divided as decimals, sums are longs.

Defined results: null text, lang and source count as empty; a group without terms has no rows of part ``term`` and, in a
language without kept terms, the value 0 to all others; a source that stands alone in its language has no pairs; repeated rows are
documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudspark.llm.common import is_small, materialize, scratch, whole_text

LEAST_DOCS, TOP = 30, 50
UNIT, PRIOR = 1_000_000_000, 5
#: Bits of a value that one histogram covers; bytes of a term that the first one does.
RADIX_BITS, RADIX_BYTES = 10, 4
#: Sources that are compared at a time.
BLOCK = 256
#: Terms that a task counts before it hands them on.
HELD_TERMS = 400_000
#: A byte of a term, in lower case, or a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; each group also has a row whose term is null."""

    def run(batches):
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms) + 1, 50_000):
                    part: list[bytes | None] = terms[at : at + 50_000]
                    counts, seen = [n[t] for t in part], [docs[t] for t in part]
                    if not at:
                        part, counts, seen = [None, *part], [0, *counts], [0, *seen]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.binary()), pa.array([source] * len(part), pa.binary()), pa.array(part, pa.binary()), pa.array(counts, pa.int64()), pa.array(seen, pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c for c in batch.columns), strict=True):
                words = text.as_py().translate(_FOLD).split()
                n, docs = held[lang.as_py(), source.as_py()]
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    bytes_of = [whole_text(c).cast("binary").alias(c) for c in ("lang", "source", "text")]
    part = docs.select(*bytes_of).mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    whole = part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return whole.withColumns({c: F.col(c).cast("string") for c in ("lang", "source", "term")})


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms))."""
    return F.expr(f"1 + cast(cast({UNIT} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(19,0)) div cast({total} + {PRIOR} * {terms} as decimal(20,0)) as long)")


def _joined(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with a materialized table, which is broadcast if ``is_small``."""
    return rows.join(F.broadcast(small) if is_small(small) else small, on, how)


def _reached(histogram: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Per group the bucket in which the running count reaches ``need``, as ``at``; ``need`` becomes what is missing before it
    and ``size`` the bucket's count."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = histogram.withColumn("upto", F.sum("size").over(running))
    return upto.filter("upto >= need AND upto - size < need").select(*keys, F.col("bucket").alias("at"), F.expr("need - (upto - size)").alias("need"), "size")


def radix_select(rows: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``value`` (a long, not below 0, descending) and ``item`` (by its bytes), with ``rank``.

    ``rows`` has only these columns and should be a written table: each histogram reads it once.
    """
    most = rows.agg(F.max(value)).first()[0] or 0
    shifts = list(range(max(most.bit_length() - RADIX_BITS, 0), 0, -RADIX_BITS)) + [0]
    size = F.count(F.lit(1)).alias("size")
    cut = None
    for i, shift in enumerate(shifts):
        at = rows if cut is None else _joined(rows, cut, keys).filter(F.expr(f"shiftright({value}, {shifts[i - 1]}) = at"))
        need = F.lit(k).cast("long") if cut is None else F.col("need")
        histogram = at.groupBy(*keys, F.expr(f"shiftright({value}, {shift})").alias("bucket"), need.alias("need")).agg(size)
        cut = materialize(_reached(histogram, keys, F.col("bucket").desc()), "cut")
    # ``at`` is now the value of the last rank, of which ``need`` rows are taken
    cuts = cut.select(*keys, F.col("at").alias("last"), "need", "size", F.lit(0).alias("width"), F.lit(b"").alias("to"))
    settled = [cuts.filter("size = need")]
    tied, width = materialize(cuts.filter("size > need"), "tied"), RADIX_BYTES
    while not tied.isEmpty():
        at = _joined(rows, tied, keys).filter(F.col(value) == F.col("last")).filter("width = 0 OR " + f"substring(cast({item} as binary), 1, width) = to")
        first = F.substring(F.col(item).cast("binary"), F.lit(1), F.lit(width))
        histogram = at.groupBy(*keys, "last", first.alias("bucket"), "need").agg(size)
        reached = _reached(histogram, [*keys, "last"], F.col("bucket").asc())
        now = materialize(reached.select(*keys, "last", "need", "size", F.lit(width).alias("width"), F.col("at").alias("to")), "tied")
        # a bucket shorter than its width holds one item, repeated: nothing can tell its rows apart
        done = "size = need OR octet_length(to) < width"
        settled.append(now.filter(done))
        tied, width = materialize(now.filter(f"NOT ({done})"), "tied"), width * 2
    cuts = settled[0]
    for more in settled[1:]:
        cuts = cuts.unionByName(more)
    cuts = materialize(cuts.select(*keys, "last", "width", "to"), "cuts")
    chosen = _joined(rows, cuts, keys, "left").filter(
        f"last IS NULL OR {value} > last OR ({value} = last AND (width = 0 OR substring(cast({item} as binary), 1, width) <= to))"
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(item).asc()))
    return chosen.select(*keys, item, value, rank.alias("rank")).filter(F.col("rank") <= k)


def _shared_terms(own: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: the correction for terms that both sources have. own: lang, term, g, p, b."""
    sides = (
        own.repartition("lang", "term")
        .groupBy("lang", "term", F.expr(f"g div {BLOCK}").alias("block"))
        .agg(F.collect_list("g").alias("g"), F.collect_list("p").alias("p"), F.collect_list("b").alias("b"))
    )
    left = sides.select("lang", "term", *[F.col(c).alias(f"{c}1") for c in ("block", "g", "p", "b")])
    right = sides.select("lang", "term", *[F.col(c).alias(f"{c}2") for c in ("block", "g", "p", "b")])
    met = left.join(right, ["lang", "term"]).filter("block1 <= block2 AND (block1 < block2 OR size(g1) > 1)")

    def run(batches):
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def flush():
            for (lang, one, two), total in sums.items():
                x, y = np.nonzero(total)
                a, b = x + one * BLOCK, y + two * BLOCK
                x, y, a, b = (v[a < b] for v in (x, y, a, b))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(total[x, y])], names=["lang", "a", "b", "value"])
            sums.clear()

        for batch in batches:
            for lang, one, two, g1, p1, b1, g2, p2, b2 in zip(*(c for c in batch.columns), strict=True):
                key = lang.as_py(), one.as_py(), two.as_py()
                if key not in sums:
                    if len(sums) == 64:
                        yield from flush()
                    sums[key] = np.zeros((BLOCK, BLOCK), np.int64)
                g1, p1, b1, g2, p2, b2 = (x.values.to_numpy() for x in (g1, p1, b1, g2, p2, b2))
                p1, b1 = p1[:, None], b1[:, None]
                sums[key][np.ix_(g1 % BLOCK, g2 % BLOCK)] += abs(p1 - p2) - abs(p1 - b2) - abs(b1 - p2) + abs(b1 - b2)
        yield from flush()

    return met.select("lang", "block1", "block2", "g1", "p1", "b1", "g2", "p2", "b2").mapInArrow(run, "lang string, a long, b long, value long")


def _pairs(own: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each ordered pair of sources of a language. groups: lang, source, g, terms (V), b."""
    one = groups.select("lang", "g", "terms", "b")
    other = groups.select("lang", F.col("g").alias("h"), F.col("b").alias("bh"))
    both = materialize(one.join(other, "lang").filter("g <> h"), "both")
    base = both.select("lang", "g", "h", F.expr("terms * abs(b - bh)").alias("value"))
    # own terms: |p - bh| - |b - bh|, as p - 2 bh + b, and twice what lies below bh
    shares = materialize(own.groupBy("lang", "g", "p", "b").agg(F.count(F.lit(1)).alias("n")), "shares")
    sums = materialize(shares.groupBy("lang", "g").agg(F.sum("n").alias("n"), F.sum(F.expr("n * p")).alias("p")), "sums")
    points = shares.select("lang", "g", F.lit(None).cast("long").alias("h"), F.col("p").alias("x"), "n").unionByName(
        both.filter("bh > b").select("lang", "g", "h", F.col("bh").alias("x"), F.lit(0).cast("long").alias("n"))
    )
    upto = Window.partitionBy("lang", "g").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = (
        points.withColumns({"n": F.sum("n").over(upto), "p": F.sum(F.expr("n * x")).over(upto)})
        .filter("h IS NOT NULL")
        .select("lang", "g", "h", F.expr("2 * (n * x - p)").alias("value"))
    )
    line = _joined(both, sums, ["lang", "g"]).select("lang", "g", "h", F.expr("CASE WHEN bh > b THEN p - 2 * n * bh + n * b ELSE p - n * b END").alias("value"))
    shared = _shared_terms(own).select("lang", F.col("a").alias("g"), F.col("b").alias("h"), "value")
    one_way = below.unionByName(line).unionByName(shared)
    parts = base.unionByName(one_way).unionByName(one_way.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    total = parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = materialize(groups.select("lang", "g", "source"), "names")
    named = _joined(total, names, ["lang", "g"])
    items = names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    return named.join(F.broadcast(items) if is_small(names) else items, ["lang", "h"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each group from its language and from each other group."""
    with scratch() as keep:
        counts = materialize(term_counts(docs), "counts")
        kept = materialize(
            counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"), "kept"
        )
        langs = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n")), "langs")
        present = materialize(_joined(counts.filter("term IS NOT NULL").drop("docs"), kept, ["lang", "term"]), "present")
        sizes = present.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = (
            counts.filter("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").transform(lambda x: _joined(x, langs, ["lang"], "left"))
            .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
            .withColumns({"terms": F.coalesce("terms", F.lit(0).cast("long")), "group_n": F.coalesce("group_n", F.lit(0).cast("long"))})
            .withColumn("b", F.when(F.col("terms") > 0, _share("0L", "group_n", "terms")).otherwise(F.lit(0).cast("long")))
        )
        groups = materialize(groups, "groups")
        valued = _joined(present, groups, ["lang", "source"]).withColumns({"p": _share("n", "group_n", "terms"), "q": _share("total", "lang_n", "terms")})
        own = materialize(valued.select("lang", "source", "term", "g", "p", "q", "b"), "own")
        above = materialize(own.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value")), "above")
        terms = radix_select(above, ["lang", "source"], "value", "item", top).withColumn("part", F.lit("term"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))
        pairs = _pairs(own.select("lang", "term", "g", "p", "b"), groups).withColumns({"part": F.lit("pair"), "rank": rank})
        columns = ["lang", "source", "part", "item", "value", "rank"]
        out = materialize(terms.select(columns).unionByName(pairs.select(columns)), "divergence")
        keep(out)
    return out


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
WITH words AS (
  SELECT lang, source, doc, unnest(regexp_extract_all(text, '{_TERM}')) AS term
  FROM (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
counts AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n, count(*) OVER (PARTITION BY g.lang, g.source) AS v
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT *, 1 + ({UNIT}::HUGEINT * (c + {PRIOR})) // (n + {PRIOR} * v) AS p,
         1 + ({UNIT}::HUGEINT * (sum(c) OVER (PARTITION BY lang, term) + {PRIOR})) // (sum(c) OVER (PARTITION BY lang) + {PRIOR} * v) AS q
  FROM dense),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP}
"""
