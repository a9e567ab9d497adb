"""Cross-site line deduplication with DataFrame operations only.

A line is a candidate if it stands on at least ``min_sites`` distinct sites, however short or long it is. Of equal texts
only the least site counts. A HyperLogLog sketch of sites for each line hash is merged by aggregation; lines whose estimate is
near the threshold get an exact distinct count. Only lines with ``min_sites`` occurrences at least can reach the threshold, so
no other line gets a sketch.

A candidate is boilerplate if it also stands in ``min_sites`` texts that have their own content. Texts most of whose lines, and
most of whose characters, are candidates may be copies of one text with changes; of those that share the least hash of their
candidate lines only one counts. So what many sites have because they copied one text stays, and all copies of a boilerplate line
are removed, from every document.

A text is read once for its line hashes, which all counts work on, and once to be cut.

Defined results: a null text stays null and has no lines; a null site counts as no site; lines are compared without
white space (blanks, tabs, carriage returns, form feeds) at either end, and what is then empty is no boilerplate; rows with
equal texts get equal results; all columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudspark.llm.common import is_small, lookup, materialize, scratch

MIN_SITES = 8
#: Estimates within this share of the threshold are counted exactly.
NEAR = 0.25
LG_K = 12
#: White space at the ends of a line.
BLANK = " \t\r\v\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.length(text).alias("n"))


def line_hashes(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(key, site, hashes, sizes, whole): of each row its text's key, its site, a hash and the characters of each line, and how
    many lines and characters there are; the hash of an empty line is null, and it does not count."""

    def of(x: Column) -> Column:
        return F.when(x != "", F.substring(F.md5(x.cast("binary")), 1, 16))

    trimmed = F.transform(_lines(docs[text_col]), lambda x: F.btrim(x, F.lit(BLANK)))
    rows = docs.select(_text_key(docs[text_col]).alias("key"), docs[site_col].cast("string").alias("site"), trimmed.alias("lines"))
    rows = rows.select("key", "site", F.transform("lines", of).alias("hashes"), F.transform("lines", F.length).alias("sizes"))
    n = F.size(F.filter("hashes", lambda x: x.isNotNull()))
    chars = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("whole", F.struct(n.alias("lines"), chars.alias("chars")))


def candidates(hashed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, n): hashes of the lines on at least ``min_sites`` distinct sites, and how often they occur there at least.
    hashed: from ``line_hashes``, materialized."""
    sited = hashed.filter("site IS NOT NULL AND hashes IS NOT NULL")
    copied = sited.groupBy("key").agg(F.min("site").alias("first"), F.max("site").alias("last"), F.count(F.lit(1)).alias("n")).filter("first <> last").drop("last")
    counted = lookup(sited, materialize(copied, "copied"), "key", "n").filter("first IS NULL OR site = first")
    lines = counted.select(F.explode("hashes").alias("line"), F.xxhash64("site").alias("site")).filter("line IS NOT NULL")
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = materialize(often.filter(f"n >= {min_sites} AND (a <> b OR {min_sites} <= 1)").select("line", "n"), "often")
    found = lookup(lines, often, "line", "n").filter("n IS NOT NULL").groupBy("line", "site").agg(F.max("n").alias("n"))
    pairs = materialize(found, "pairs")
    spread = materialize(pairs.groupBy("line").agg(F.max("n").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites")), "spread")
    near = F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))
    open_lines = materialize(spread.filter(near).select(F.col("line").alias("of")), "near")
    open_lines = F.broadcast(open_lines) if is_small(open_lines) else open_lines
    exact = pairs.join(open_lines, F.col("line") == F.col("of"), "left_semi").groupBy("line").agg(F.max("n").alias("n"), F.count_distinct("site").alias("sites"))
    sure = spread.filter(F.col("sites") > min_sites * (1 + NEAR))
    return materialize(sure.select("line", "n").unionByName(exact.filter(f"sites >= {min_sites}").select("line", "n")), "candidates")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, n): the candidates in at least ``min_sites`` texts with content of their own, or groups of others.
    found: the places (key, pos, line, n, size) of candidates in texts, which have so many lines and characters (whole)."""
    per_text = found.groupBy("key").agg(F.collect_set(F.struct("line", "n")).alias("lines"), F.count(F.lit(1)).alias("many"), F.sum("size").alias("much"), F.min("line").alias("least"), F.max("whole").alias("whole"))
    copied = (F.col("many") * 2 > F.col("whole.lines")) & (F.col("much") * 2 > F.col("whole.chars"))
    group = F.when(copied, F.col("least")).otherwise(F.concat_ws(":", "key.a", "key.b", "key.n"))
    pairs = per_text.select(F.explode("lines").alias("x"), group.alias("group")).groupBy("x.line", "group").agg(F.max("x.n").alias("n"))
    return materialize(pairs.groupBy("line").agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("n")).filter(f"groups >= {min_sites}").select("line", "n"), "boilerplate")


def _without(text: Column, at: Column) -> Column:
    """The text without its lines at the places ``at`` (from 0, in order): the stretches between them."""
    bounds = F.concat(F.array(F.lit(-1)), at, F.array(F.size(_lines(text))))
    whole = F.array(F.struct(_lines(text).alias("lines"), bounds.alias("bounds")))  # bound by transform: read at each step

    def stretches(x: Column) -> Column:
        def between(i: Column) -> Column:
            a, b = F.get(x["bounds"], i), F.get(x["bounds"], i + 1)
            return F.slice(x["lines"], a + 2, b - a - 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["bounds"]) - 2), between))

    return F.array_join(F.transform(whole, stretches)[0], "\n")


def remove(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, text, removed): the row as a struct, its text without boilerplate lines, and how many lines went."""
    with scratch() as keep:
        hashed = materialize(line_hashes(docs, text_col, site_col), "lines")
        own = hashed.filter("hashes IS NOT NULL")
        # the lists are left behind before rows are made of them, or each row would carry them
        zipped = own.select("key", "whole", F.arrays_zip("hashes", "sizes").alias("lines"))
        places = zipped.select("key", "whole", F.posexplode("lines").alias("pos", "x"))
        places = places.select("key", "whole", "pos", F.col("x.hashes").alias("line"), F.col("x.sizes").alias("size")).filter("line IS NOT NULL")
        met = lookup(places, candidates(hashed, min_sites), "line", "n").filter("n IS NOT NULL")
        # a place of a text once, however many rows have the text
        met = met.groupBy("key", "pos").agg(F.max("line").alias("line"), F.max("n").alias("n"), F.max("size").alias("size"), F.max("whole").alias("whole"), F.count(F.lit(1)).alias("rows"))
        met = materialize(met, "places")
        hit = lookup(met.drop("n"), boilerplate(met, min_sites), "line", "n").filter("n IS NOT NULL")
        marked = hit.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("at"), F.max("rows").alias("rows"))
        marked = materialize(marked, "marked")
        keep(marked)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[text_col].alias("text"), _text_key(docs[text_col]).alias("key"))
    cut = F.when(F.col("at").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("at")))
    removed = F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long")
    return lookup(rows, marked, "key", "rows").select("doc", cut.alias("text"), removed.alias("removed"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 (of the text that is left; a null text counts as empty)."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    rows = remove(docs.select("doc_id", "source", "text", n_lines.alias("n_lines")))
    return rows.select("doc.doc_id", "doc.n_lines", F.col("removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents
), keyed AS (
  SELECT r, text, pos, line FROM (
    SELECT r, text, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
    FROM (SELECT r, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM lines)) WHERE line <> ''
), home AS (
  SELECT text, min(source) AS source FROM documents WHERE source IS NOT NULL GROUP BY text
), candidate AS (
  SELECT line FROM keyed JOIN home USING (text) GROUP BY line HAVING count(DISTINCT home.source) >= {MIN_SITES}
), once AS (
  SELECT text, line, line IN (SELECT line FROM candidate) AS often FROM keyed WHERE r IN (SELECT min(r) FROM lines GROUP BY text)
), grouped AS (
  SELECT text, CASE WHEN 2 * count(*) FILTER (often) > count(*) AND 2 * sum(length(line)) FILTER (often) > sum(length(line))
                    THEN 'lines ' || min(left(md5(line), 16)) FILTER (often) ELSE 'text ' || md5(text) END AS own
  FROM once GROUP BY text
), bad AS (
  SELECT line FROM once JOIN grouped USING (text) WHERE often GROUP BY line HAVING count(DISTINCT own) >= {MIN_SITES}
), hit AS (
  SELECT r, list(pos) AS gone FROM keyed WHERE line IN (SELECT line FROM bad) GROUP BY r
), marked AS (
  SELECT l.doc_id, l.ls, coalesce(h.gone, []) AS gone FROM lines l LEFT JOIN hit h ON l.r = h.r
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
         [ls[i] FOR i IN generate_series(1, len(ls)) IF NOT list_contains(gone, i)], chr(10)), '')) AS text_sha256
FROM marked
"""
