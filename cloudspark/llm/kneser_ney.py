"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text and language-specific quantiles.

The model reads characters, of any script, in grams of up to ORDER. Counts, continuation counts, contexts and
interpolation are tables in shards keyed by gram, joined by gram; none of them passes through the driver.

Written with backing off, the logarithm of an interpolated probability is a sum with one term for each gram that ends
at a character: what the gram adds to the probability of its suffix, and, as the next character's context, its share of
the discounts. A gram that the trusted text lacks adds nothing. So a text's log probability is the sum over its distinct
grams of count times weight, a join of the text's grams with the weights: the HOT most frequent grams are broadcast, a
document's other grams are joined to the sharded table. A bit table of at most COLD_BITS bits keeps most grams that the
trusted text lacks out of that join; it never loses one that it has.

A document is rejected if its cross entropy lies above a high quantile of trusted documents of its language that the
model was not trained on, times SLACK. Entropies of short texts are drawn towards the trusted mean.

Defined results: a null or empty text has only its end and is accepted; a language without held-out
trusted documents has no threshold and keeps all its documents, as does a null language; labels that are null, repeated
or contradictory make a document trusted only if all of them are (quality 1, not toxic); rows with equal ids share their
labels; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import BROADCAST_ROWS, is_small, lookup, materialize, resident, scratch

ORDER = 4
#: Grams that are broadcast, and bits of the table of all others.
HOT, COLD_BITS = 1 << 18, 1 << 26
#: One trusted document in so many sets thresholds instead of training.
HELD_OUT = 4
QUANTILE = 0.995
SLACK = 1.08
#: Characters at the trusted mean that are added to each text.
PRIOR_CHARS = 100
#: Histogram bins for one nat.
BINS = 1000
#: Code points that no text has: what stands before a text, and its end.
BEFORE, END = 0x110000, 0x110001
#: Distinct grams that a task counts before it passes partial counts on.
FLUSH = 1 << 20
#: Characters that are worked on at once.
PART = 1 << 19
#: Of the 64-bit keys of grams.
SEED, MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

C = [f"c{i}" for i in range(1, ORDER + 1)]  # characters of a gram; one of order k has the last k of them


def symbols(text: str | None) -> np.ndarray:
    """Code points of a text between ORDER starts and one end."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([np.full(ORDER, BEFORE, "<u4"), chars, np.array([END], "<u4")])


def keys(codes: np.ndarray) -> list[np.ndarray]:
    """Keys of the grams of order 1 to ORDER that end at each symbol from the last start on."""
    n, out = len(codes) - ORDER + 1, []
    wide, h = codes.astype(np.uint64), np.full(n, SEED, np.uint64)
    for k in range(ORDER):
        h = (h ^ wide[ORDER - 1 - k :][:n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def key_of(grams: np.ndarray, order: int) -> np.ndarray:
    """Keys of grams of one order, given as rows of ORDER code points."""
    h = np.full(len(grams), SEED, np.uint64)
    for k in range(order):
        h = (h ^ grams[:, ORDER - 1 - k].astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of several texts one after the other, and the place of each text's last start."""
    own = [symbols(x) for x in texts]
    ends = np.cumsum([len(x) for x in own])
    return np.concatenate(own), np.concatenate([[0], ends[:-1]]).astype(np.int64) + ORDER - 1


def parts(texts: list[str | None], most: int = PART) -> Iterator[slice]:
    """Slices of some ``most`` characters or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + ORDER
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def gram_counts(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(c1..c4, n) of all grams of the highest order."""

    def run(batches):
        held: dict[int, list] = {}

        def out():
            rows = list(held.values())
            held.clear()
            cols = list(zip(*rows, strict=True)) or [[]] * (ORDER + 1)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:-1]), pa.array(cols[-1], pa.int64())], names=[*C, "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in parts(texts):
                codes, _ = joined(texts[s])
                real = codes[ORDER - 1 :] != BEFORE
                own, first, n = np.unique(keys(codes)[-1][real], return_index=True, return_counts=True)
                grams = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[np.flatnonzero(real)[first]].tolist()
                for key, gram, count in zip(own.tolist(), grams, n.tolist(), strict=True):
                    if key in held:
                        held[key][-1] += count
                    else:
                        held[key] = [*gram, count]
                if len(held) > FLUSH:
                    yield out()
        yield out()

    kinds = ", ".join(f"{c} int" for c in C)
    return trusted.select(text_col).mapInArrow(run, f"{kinds}, n long").groupBy(*C).agg(F.sum("n").alias("n"))


def discounts(n: dict[int, int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many grams have the counts 1 to 4."""
    if not n.get(1) or not n.get(2):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    most = (0.95, 1.9, 2.9)
    return [min(max(i - (i + 1) * y * n.get(i + 1, 0) / n[i], 0.05), most[i - 1]) if n.get(i) else 0.9 for i in (1, 2, 3)]


@dataclass
class Model:
    """Weights (order, c1..c4, w, v, occ): what a gram adds, that with its suffixes, and how often it occurs."""

    weights: DataFrame
    unseen: float  # ln of the probability of a character that the trusted text lacks
    mean: float  # entropy of the training text


def fit(trusted: DataFrame, text_col: str = "text") -> Model:
    with scratch() as keep:
        model = _fit(trusted, text_col)
        keep(model.weights)
    return model


def _fit(trusted: DataFrame, text_col: str) -> Model:
    counts = {ORDER: materialize(gram_counts(trusted, text_col).withColumn("occ", F.col("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        longer = counts[k + 1]
        own = longer.groupBy(*C[ORDER - k :]).agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("occ"))
        counts[k] = materialize(own, "grams")
    few = reduce(DataFrame.unionByName, [t.filter("n <= 4").groupBy("n").count().withColumn("k", F.lit(k)) for k, t in counts.items()]).collect()
    cut = {k: discounts({r.n: r["count"] for r in few if r.k == k}) for k in counts}

    def discount(k: int) -> Column:
        a, b, c = map(F.lit, cut[k])
        return F.when(F.col("n") == 1, a).when(F.col("n") == 2, b).otherwise(c)

    whole = counts[1].agg(F.sum("n").alias("total"), F.sum(discount(1)).alias("cut"), F.count(F.lit(1)).alias("v")).first()
    if not whole.total:
        kinds = ", ".join(f"{c} int" for c in C)
        none = trusted.sparkSession.createDataFrame([], f"k int, {kinds}, w double, v double, occ long")
        return Model(materialize(none, "weights"), -float(np.log(1 << 21)), float(np.log(1 << 21)))
    unseen = whole["cut"] / whole["total"] / (whole["v"] + 1)
    p = counts[1].select(C[-1], "n", "occ", ((F.col("n") - discount(1)) / whole["total"] + unseen).alias("p"))
    p = p.withColumn("own", F.log("p") - float(np.log(unseen)))
    weights = []
    lower = None  # weights of the order below, with suffixes
    for k in range(1, ORDER + 1):
        gram = C[ORDER - k :]
        if k < ORDER:  # the gram as a context of the next order: its share of the discounts
            context = [F.col(a).alias(b) for a, b in zip(C[ORDER - k - 1 : -1], gram, strict=True)]
            left = counts[k + 1].groupBy(*context).agg((F.sum(discount(k + 1)) / F.sum("n")).alias("back"), F.sum("occ").alias("as_context"))
            both = p.join(left, gram, "full")
            w = F.coalesce("own", F.lit(0.0)) + F.coalesce(F.log("back"), F.lit(0.0))
            own = both.select(*gram, "p", "back", w.alias("w"), F.coalesce("occ", "as_context").alias("occ"))
        else:
            own = p.select(*gram, "p", F.lit(None).cast("double").alias("back"), F.col("own").alias("w"), "occ")
        if lower is None:
            own = own.withColumn("v", F.col("w"))
        else:
            own = own.join(lower.select(*gram[1:], F.col("v").alias("rest")), gram[1:], "left").withColumn("v", F.col("w") + F.coalesce("rest", F.lit(0.0))).drop("rest")
        own = materialize(own, "weights")
        weights.append(own.select(F.lit(k).alias("k"), *[F.col(c) if c in gram else F.lit(None).cast("int").alias(c) for c in C], "w", "v", "occ"))
        if k < ORDER:
            wide = C[ORDER - k - 1 :]
            held = own.filter("back IS NOT NULL").select(*[F.col(a).alias(b) for a, b in zip(gram, wide[:-1], strict=True)], "back")
            suffix = own.filter("p IS NOT NULL").select(*gram, F.col("p").alias("low"))
            p = counts[k + 1].join(held, wide[:-1]).join(suffix, gram)
            sums = counts[k + 1].groupBy(*wide[:-1]).agg(F.sum("n").alias("total"))
            p = p.join(sums, wide[:-1]).select(*wide, "n", "occ", ((F.col("n") - discount(k + 1)) / F.col("total") + F.col("back") * F.col("low")).alias("p"), "back", "low")
            p = p.withColumn("own", F.log("p") - F.log("back") - F.log("low")).drop("back", "low")
        else:
            mean = own.join(counts[ORDER].select(*C, F.col("n").alias("m")), C).agg(-F.sum(F.col("m") * F.log("p")) / F.sum("m")).first()[0]
        lower = own
    table = materialize(reduce(DataFrame.unionByName, weights), "weights")
    return Model(table, float(np.log(unseen)), mean)


def keyed(weights: DataFrame) -> DataFrame:
    """(key, w, v, occ): grams by their keys."""

    def run(batches):
        for batch in batches:
            order = batch.column(0).to_numpy()
            grams = np.stack([batch.column(i + 1).fill_null(0).to_numpy(zero_copy_only=False) for i in range(ORDER)], 1)
            key = np.zeros(len(order), np.uint64)
            for k in range(1, ORDER + 1):
                key[order == k] = key_of(grams[order == k], k)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns[-3:]], names=["key", "w", "v", "occ"])

    return weights.mapInArrow(run, "key long, w double, v double, occ long")


class Table:
    """Values by 64-bit key, found for whole arrays at once; open addressing in a table twice as large as needed."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(key)).bit_length())
        self.mask, self.key, self.value, self.full = np.uint64(size - 1), np.zeros(size, np.uint64), np.zeros(size), np.zeros(size, bool)
        self.reach, todo = 0, np.arange(len(key))
        while len(todo):
            at = ((key[todo] + np.uint64(self.reach)) & self.mask).astype(np.int64)
            free = ~self.full[at]
            _, one = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[one]
            self.key[at[took]], self.value[at[took]], self.full[at[took]] = key[todo[took]], value[todo[took]], True
            todo = np.delete(todo, took)
            self.reach += 1

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, 0 without one, and whether there is one."""
        at = (key & self.mask).astype(np.int64)
        found = self.full[at] & (self.key[at] == key)
        out = np.where(found, self.value[at], 0.0)
        todo = np.flatnonzero(~found & self.full[at])
        for step in range(1, self.reach):
            if not len(todo):
                break
            at = ((key[todo] + np.uint64(step)) & self.mask).astype(np.int64)
            hit = self.full[at] & (self.key[at] == key[todo])
            out[todo[hit]], found[todo[hit]] = self.value[at[hit]], True
            todo = todo[~hit & self.full[at]]
        return out, found


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, hot: int = HOT, cold_bits: int = COLD_BITS) -> DataFrame:
    """(doc, chars, ln_p, entropy): the row as a struct, its symbols (the end included), ln of its probability, and nats a
    symbol drawn to the mean."""
    with scratch() as keep:
        return _score(docs, model, text_col, keep_text, hot, cold_bits, keep)


def _score(docs: DataFrame, model: Model, text_col: str, keep_text: bool, hot: int, cold_bits: int, keep: Callable[[DataFrame], None]) -> DataFrame:
    spark = docs.sparkSession
    table = materialize(keyed(model.weights), "keyed")
    top = table.orderBy(F.desc("occ"), "key").limit(hot).select("key", "v", "occ").toPandas()
    least = int(top["occ"].min()) if len(top) == hot else -1
    last = int(top["key"][top["occ"] == least].max()) if least >= 0 else 0
    cold = table.filter((F.col("occ") < least) | ((F.col("occ") == least) & (F.col("key") > last))).select("key", "w")
    cell = F.pmod("key", F.lit(cold_bits))
    bits = cold.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(key, {cold_bits}) & 63 as int)))").alias("bits")).toPandas()
    packed = (top["key"].to_numpy(np.int64).tobytes(), top["v"].to_numpy(np.float64).tobytes(), bits["word"].to_numpy(np.int64).tobytes(), bits["bits"].to_numpy(np.int64).tobytes())
    shipped = spark.sparkContext.broadcast(packed)
    names = [c for c in docs.columns if keep_text or c != text_col]
    name, unseen = f"kneser-ney {table._written_to}", model.unseen

    def build():
        key, value, word, bits = (np.frombuffer(x, t) for x, t in zip(shipped.value, ("<u8", "<f8", "<i8", "<u8"), strict=True))
        words = np.zeros(cold_bits // 64 if len(word) else 0, np.uint64)
        words[word] = bits
        return Table(key, value), words

    def run(batches):
        table, words = resident(name, build)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, logs, rows = np.zeros(len(texts), np.int64), np.zeros(len(texts)), []
            for s in parts(texts):
                size = s.stop - s.start
                codes, last = joined(texts[s])
                owner = np.repeat(np.arange(size), np.diff(np.append(last, len(codes) + ORDER - 1)))
                read = codes != BEFORE
                read[last] = True
                at = np.flatnonzero(read) - (ORDER - 1)
                n[s] = np.bincount(owner[at], minlength=size) - 1
                unknown, of = [], []
                own = keys(codes)
                for k in reversed(range(ORDER)):  # a gram that is not hot: its own weight is asked for, its suffix looked up
                    key = own[k][at]
                    value, found = table.find(key)
                    logs[s] += np.bincount(owner[at], value, size)
                    at, key = at[~found], key[~found]
                    if len(words) and len(key):
                        cell = key.view(np.int64) % cold_bits
                        asked = (words[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
                        unknown.append(key[asked])
                        of.append(owner[at[asked]])
                    if not len(at):
                        break
                listed: list[list] = [[] for _ in range(size)]
                if unknown:
                    one, many = np.unique(np.rec.fromarrays([np.concatenate(of), np.concatenate(unknown).view(np.int64)]), return_counts=True)
                    for (text, key), count in zip(one.tolist(), many.tolist(), strict=True):
                        listed[text].append({"key": key, "n": count})
                rows += listed
            logs += n * unseen
            kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(logs), pa.array(rows, kind)], names=["doc", "chars", "ln_p", "cold"])

    doc = T.StructType([docs.schema[c] for c in names])
    grams = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("doc", doc), T.StructField("chars", T.LongType()), T.StructField("ln_p", T.DoubleType()), T.StructField("cold", grams)])
    local = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs[text_col].alias("text")).mapInArrow(run, schema)
    local = materialize(local.withColumn("row", F.monotonically_increasing_id()), "scored")
    keep(local)
    entropy = (F.lit(PRIOR_CHARS * model.mean) - F.col("ln_p")) / (F.col("chars") + PRIOR_CHARS)
    sure = local.filter("size(cold) = 0").drop("cold", "row")
    asked = local.filter("size(cold) > 0").select("row", F.explode("cold").alias("x")).select("row", "x.*")
    needed = asked.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    found = materialize(needed.join(cold, "key"), "cold")
    added = lookup(asked, found, "key", "weight").filter("w IS NOT NULL").groupBy("row").agg(F.sum(F.col("n") * F.col("w")).alias("more"))
    added = materialize(added, "added")
    keep(added)
    open_rows = local.filter("size(cold) > 0").drop("cold")
    added = F.broadcast(added) if is_small(added) else added
    rest = open_rows.join(added, "row", "left").withColumn("ln_p", F.col("ln_p") + F.coalesce("more", F.lit(0.0))).drop("row", "more")
    return sure.unionByName(rest).withColumn("entropy", entropy)


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.groupBy("doc_id").agg(F.min(good).alias("good")).filter("good AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"))


def only(rows: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """``ids`` must be materialized."""
    return rows.join(F.broadcast(ids) if is_small(ids, BROADCAST_ROWS) else ids, key == ids["__id"], "left_semi")


def _is_held_out(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) == 0


def thresholds(scored: DataFrame) -> DataFrame:
    """(of, most): QUANTILE of ``entropy`` by language, exact to a bin of 1 / BINS, times SLACK. scored: lang, entropy."""
    bins = scored.groupBy(F.col("lang").alias("of"), F.floor(F.col("entropy") * BINS).alias("bin")).count()
    return bins.groupBy("of").agg(((F.percentile(F.col("bin"), QUANTILE, F.col("count")) + 1) / BINS * SLACK).alias("most"))


def classify(docs: DataFrame, labels: DataFrame, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc, chars, ln_p, entropy, most, accepted): a row of ``docs`` as a struct, and the decision on it."""
    ids = materialize(trusted_ids(labels), "trusted")
    own = only(docs, ids, docs[id_col])
    model = fit(own.filter(~_is_held_out(F.col(id_col))), text_col)
    scored = score(docs, model, text_col, keep_text)
    held = only(scored, ids, scored[f"doc.{id_col}"]).filter(_is_held_out(F.col(f"doc.{id_col}")))
    limits = materialize(thresholds(held.select(F.col(f"doc.{lang_col}").alias("lang"), "entropy")), "limits")
    limits = F.broadcast(limits) if is_small(limits) else limits
    accepted = (F.col("chars") <= 1) | F.coalesce(F.col("entropy") <= F.col("most"), F.lit(True))
    return scored.join(limits, F.col(f"doc.{lang_col}") == F.col("of"), "left").drop("of").withColumn("accepted", accepted)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, n_symbols (with the end), perplexity, drawn_perplexity, threshold (the largest drawn
    perplexity that is accepted), accepted."""
    rows = classify(docs.select("doc_id", "text", "lang"), labels, keep_text=False)
    return rows.select(
        "doc.doc_id",
        "doc.lang",
        F.col("chars").alias("n_symbols"),
        F.exp(-F.col("ln_p") / F.col("chars")).alias("perplexity"),
        F.exp("entropy").alias("drawn_perplexity"),
        F.exp("most").alias("threshold"),
        "accepted",
    )
