"""Language-model scoring with a hidden Markov model.

Tokens are words and one end for each text. Training counts all tokens. The HEAD most frequent words have a symbol
of their own; every other word has the symbol of its ending, and within that symbol a word's probability is its share
of the counts, one share being left for words never seen. So what workers hold is bounded at any size of corpus,
frequent words never meet in a shuffle join, and the model is a proper distribution over texts.

Baum-Welch: each pass runs forward and backward over all training texts; expected counts are summed within and across
partitions. The start is fitted on stretches of a bounded sample of START_TEXTS texts; all counts behind the final parameters cover
the whole corpus. The scaled forward recursion gives the exact likelihood of a text.

Defined results: a null or empty text is one end token; a null id trains like the id ''; with no training text all
words are unknown; rows with equal ids are scored one by one; ids may be of any type; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import materialize

STATES = 8
HEAD = 30_000
ENDINGS = 512
PASSES = 2
#: The start is fitted on so many texts, of each a stretch of at most so many tokens, in so many passes.
START_TEXTS, START_TOKENS, START_PASSES = 1_000, 8_192, 12
#: Weight in tokens of the unigram distribution in each state's emissions.
PRIOR = 200.0
#: Tokens worked on at once, and sequences side by side.
CHUNK, LANES = 1 << 18, 512
#: The end of a text; no word holds a line break.
END = b"\n"
#: Distinct words counted before partial counts are passed on.
FLUSH = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; ``bytes`` methods split at and lower ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def lanes(texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Texts laid end to end in columns: symbols (-1: none), columns where a text starts at each step, text of each cell."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    total = sum(map(len, texts))
    steps = max(len(texts[order[0]]), -(-total // LANES))
    width = min(LANES, len(texts), max(1, -(-total // steps) + 1))
    fill = [(0, j) for j in range(width)]
    place, high = [], 0
    for i in order:
        at, j = heapq.heappop(fill)
        place.append((i, at, j))
        heapq.heappush(fill, (at + len(texts[i]), j))
        high = max(high, at + len(texts[i]))
    cells, owner = np.full((high, width), -1, np.int32), np.full((high, width), len(texts), np.int32)
    begins: list[list[int]] = [[] for _ in range(high)]
    for i, at, j in place:
        cells[at : at + len(texts[i]), j] = texts[i]
        owner[at : at + len(texts[i]), j] = i
        begins[at].append(j)
    return cells, [np.array(b, np.int64) for b in begins], owner


def forward(model: Model, cells: np.ndarray, begins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables, scales and emissions of all cells."""
    seen = model.emit[np.maximum(cells, 0)]
    seen[cells < 0] = 1
    alpha, scale = np.empty_like(seen), np.ones(cells.shape, np.float32)
    now = np.tile(model.start, (cells.shape[1], 1))
    for t in range(len(cells)):
        if t:
            now = now @ model.move
        if len(begins[t]):
            now[begins[t]] = model.start
        now *= seen[t]
        scale[t] = s = now.sum(1)
        now /= s[:, None]
        alpha[t] = now
    return alpha, scale, seen


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's symbols."""
    cells, begins, owner = lanes(texts)
    _, scale, _ = forward(model, cells, begins)
    return np.bincount(owner.ravel(), np.log10(scale, dtype=np.float64).ravel(), len(texts) + 1)[:-1]


def expected(model: Model, texts: list[np.ndarray]) -> Model:
    """Expected counts of starts, moves and emissions."""
    cells, begins, _ = lanes(texts)
    alpha, scale, seen = forward(model, cells, begins)
    beta = np.ones((cells.shape[1], model.start.size), np.float32)
    gamma = np.empty_like(alpha)
    back = model.move.T.copy()
    for t in range(len(cells) - 1, -1, -1):
        gamma[t] = alpha[t] * beta
        seen[t] *= beta / scale[t][:, None]  # from here on: what a move into this cell weighs
        beta = seen[t] @ back
        if len(begins[t]):
            beta[begins[t]] = 1
            if t:
                seen[t][begins[t]] = 0
    k = model.start.size
    inside = (cells[1:] >= 0)[..., None]
    moves = model.move * (alpha[:-1].reshape(-1, k).T @ (seen[1:] * inside).reshape(-1, k))
    starts = sum((gamma[t][b].sum(0) for t, b in enumerate(begins) if len(b)), np.zeros(k))
    flat, real = cells.ravel(), cells.ravel() >= 0
    emits = np.stack([np.bincount(flat[real], gamma[..., j].ravel()[real], len(model.emit)) for j in range(k)], 1)
    return Model(starts, moves.astype(np.float64), emits)


def maximise(counts: Model, share: np.ndarray) -> Model:
    """Parameters from expected counts; ``share`` is the symbols' unigram distribution."""
    emit = counts.emit + PRIOR * share[:, None]
    move = counts.move + 1.0
    start = counts.start + 1.0
    return Model(
        (start / start.sum()).astype(np.float32),
        (move / move.sum(1, keepdims=True)).astype(np.float32),
        (emit / emit.sum(0)).astype(np.float32),
    )


def chunks(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    part: list[np.ndarray] = []
    size = 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def first_model(sample: list[np.ndarray], share: np.ndarray) -> Model:
    """Start values: noise around the unigram distribution, sharpened by Baum-Welch on the sample."""
    noise = np.random.default_rng(0).gamma(1.0, 1.0, (len(share), STATES))
    model = maximise(Model(np.ones(STATES), np.ones((STATES, STATES)) + 20 * np.eye(STATES), share[:, None] * noise * 1e4), share)
    for _ in range(START_PASSES if sample else 0):
        total = None
        for part in chunks(sample):
            now = expected(model, part)
            total = now if total is None else Model(total.start + now.start, total.move + now.move, total.emit + now.emit)
        model = maximise(total, share)
    return model


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """(word, ending, n) of all training tokens."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            words = list(seen)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([ending(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "ending", "n"],
            )
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return train.select(text_col).mapInArrow(run, "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def symbols_of(docs: DataFrame, text_col: str, head: dict[bytes, tuple[int, int]], ends: int, rest: np.ndarray) -> DataFrame:
    """Each row's symbols and what its head words add to the base score.

    head: symbol and count of each head word. ends: count of ends. rest: by ending, log10 of the weight of all words
    without a symbol of their own and of the unseen one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((head, ends, rest))

    def run(batches):
        head, ends, rest = shipped.value
        number = {w: s for w, (s, _) in head.items()}
        weight = np.zeros(1 + len(head) + ENDINGS)
        weight[0] = np.log10(ends + 1)
        for s, c in head.values():
            weight[s] = np.log10(c + 1)
        by_end: dict[bytes, int] = {}
        base = 1 + len(head)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column(3):
                words = tokens(text.as_py())
                syms = list(map(number.get, words))
                tail: Counter = Counter()
                for i, s in enumerate(syms):
                    if s is None:
                        w = words[i]
                        tail[w] += 1
                        e = by_end.get(w[-2:])
                        if e is None:
                            e = by_end[w[-2:]] = ending(w)
                        syms[i] = base + e
                syms.append(0)
                a = np.array(syms, "<u2")
                cols[0].append(a.tobytes())
                cols[1].append(len(syms))
                cols[2].append(float(weight[a].sum()))
                cols[3].append(float(rest[a[a >= base] - base].sum()))
                cols[4].append([{"word": w, "n": n} for w, n in tail.items()])
            kinds = [pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["row", "doc_id", "held_out", "symbols", "n_tokens", "head_sum", "rest_sum", "tail"],
            )

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", text_col).mapInArrow(
        run,
        T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], *T._parse_datatype_string("held_out boolean, symbols binary, n_tokens long, head_sum double, rest_sum double, tail array<struct<word:binary,n:int>>")]),
    )


def baum_welch(train: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One pass over all rows of ``train`` (symbols)."""
    spark = train.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    k, size = STATES, len(share)
    names = [f"e{i}" for i in range(k)]

    def run(batches):
        model = shipped.value
        total = Model(np.zeros(k), np.zeros((k, k)), np.zeros((size, k)))
        for batch in batches:
            for part in chunks([np.frombuffer(x.as_py(), "<u2") for x in batch.column(0)]):
                now = expected(model, part)
                total.start += now.start
                total.move += now.move
                total.emit += now.emit
        used = np.flatnonzero(total.emit.any(1))
        keys = np.concatenate([used, size + np.arange(k + 1)]).astype(np.int32)
        values = np.concatenate([total.emit[used], total.move, total.start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=["key", *names])

    summed = train.select("symbols").mapInArrow(run, f"key int, {', '.join(f'{n} double' for n in names)}").groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    table = np.zeros((size + k + 1, k))
    table[summed["key"].to_numpy()] = summed[names].to_numpy()
    return maximise(Model(table[-1], table[size:-1], table[:size]), share)


@dataclass
class Fitted:
    model: Model
    rows: DataFrame  # of all texts, from symbols_of
    counts: DataFrame  # word, ending, n
    n: int
    v: int


def fit(docs: DataFrame, text_col: str = "text") -> Fitted:
    """docs: doc_id, held_out and the text; learns from rows that are not held out."""
    counts = materialize(word_counts(docs.filter("NOT held_out"), text_col), "words")
    by_end = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = sum(x.n for x in by_end), sum(x.v for x in by_end)
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD + 1).collect()
    ends = next((x.n for x in top if bytes(x.word) == END), 0)
    top = [x for x in top if bytes(x.word) != END][:HEAD]
    head = {bytes(x.word): (i + 1, x.n) for i, x in enumerate(top)}
    # of each ending, the tokens and the weight (count + 1 for each word) of what has no symbol of its own
    left, weight = np.zeros(ENDINGS), np.ones(ENDINGS)
    for x in by_end:
        left[x.ending] += x.n
        weight[x.ending] += x.n + x.v
    for x in [*top, *([{"ending": ending(END), "n": ends}] if ends else [])]:
        left[x["ending"]] -= x["n"]
        weight[x["ending"]] -= x["n"] + 1
    share = np.concatenate([[ends + 1.0], [c + 1.0 for _, c in head.values()], left + 1.0])
    share /= share.sum()
    rows = materialize(symbols_of(docs, text_col, head, ends, np.log10(weight)), "symbols")
    train = rows.filter("NOT held_out")
    # a stretch of a text of any length, where its hash says; all texts count in the passes below
    stretch = F.expr(f"substring(symbols, cast(1 + 2 * {START_TOKENS} * pmod(xxhash64(symbols, 1), ceil(n_tokens / {START_TOKENS})) as int), 2 * {START_TOKENS})")
    sample = train.select(F.xxhash64("symbols").alias("h"), stretch.alias("symbols")).orderBy("h", "symbols").limit(START_TEXTS).collect()
    model = first_model([np.frombuffer(x.symbols, "<u2") for x in sample], share)
    for _ in range(PASSES if n else 0):
        model = baum_welch(train, model, share)
    return Fitted(model, rows, counts, n, v)


def score(fitted: Fitted) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shipped = fitted.rows.sparkSession.sparkContext.broadcast(fitted.model)

    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(6)]
            logs = np.concatenate([*(log_likelihood(shipped.value, part) for part in chunks(texts)), np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(logs)], names=[*batch.schema.names[:6], "log"])

    own = ["row", "doc_id", "held_out", "n_tokens", "head_sum", "rest_sum"]
    kinds = T.StructType([*(fitted.rows.schema[c] for c in own), T.StructField("log", T.DoubleType())])
    logs = fitted.rows.select(*own, "symbols").mapInArrow(run, kinds)
    tail = (
        fitted.rows.select("row", F.explode("tail").alias("x"))
        .select("row", F.col("x.word").alias("word"), F.col("x.n").alias("m"))
        .join(fitted.counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.coalesce(F.col("m") * F.log10(F.col("n") + F.lit(1.0)), F.lit(0.0))).alias("tail_sum"),
            F.sum("m").alias("tail_n"),
            F.sum(F.when(F.col("n").isNull(), F.col("m")).otherwise(0)).alias("unknown"),
        )
    )
    zero = F.lit(0).cast("long")
    ends_known = F.lit(0 if fitted.n else 1).cast("long")
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    return logs.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.coalesce("unknown", zero) - ends_known).alias("n_known"),
        F.lit(fitted.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * float(np.log10(fitted.n + fitted.v + 1))).alias("base_score"),
        (F.col("log") + tail_sum - F.col("rest_sum")).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``documents``, learned from those whose crc32(doc_id as text) mod 7 is not 2."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return score(fit(docs.select("doc_id", held_out.alias("held_out"), "text")))
