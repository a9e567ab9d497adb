"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of consecutive item words, a node for each word. A document is normalised to its words,
scanned once, and matches are mapped to word positions and, for ``spans``, to character offsets of the original text.

The benchmark is read in blocks of at most MAX_NODES words of windows, so that what is broadcast and what a worker holds
have a bound; each block is one scan over all documents. A usual benchmark is one block: 400,000 windows of ten words.

Defined results: a null or empty text has no words and no hits; an item without words has no window; items that
share windows are all reported; an item without an id makes hits but is not reported; an empty benchmark leaves every
document clean; ids of any type and other columns, whatever their names, pass through; rows with equal texts get equal
results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import materialize, resident

WINDOW = 10
#: Nodes of an automaton (words of its windows), some 60 bytes each in a worker; a larger benchmark is read in blocks.
MAX_NODES = 4 << 20
#: Name of the column that is added.
OUT = "__found"

#: Bytes of words: digits, letters in lower case, all of non-ASCII characters; others become a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hits", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Windows:
    """One Aho-Corasick automaton over windows of words; words that no window has are number 0."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]) -> None:
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, items in windows.items():
            self.automaton.add_word(tuple(self.number.setdefault(x, len(self.number) + 1) for x in w), (len(w), items))
        if windows:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """A boolean for each word (None: no hit), the items that occur."""
        number = self.number.get
        line = tuple([number(w, 0) for w in words])
        if not any(line):
            return None, set()
        ends, sizes, items = [], [], set()
        for at, (n, own) in self.automaton.iter(line):
            ends.append(at)
            sizes.append(n)
            items.update(own)
        if not ends:
            return None, items
        edge = np.zeros(len(words) + 1, np.int64)
        last = np.asarray(ends) + 1
        np.add.at(edge, last - np.asarray(sizes), 1)
        np.add.at(edge, last, -1)
        return np.cumsum(edge[:-1]) > 0, items


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in characters of the original text."""
    out, start = [], -1
    for i, c in enumerate(text):
        if c > "\x7f" or c.isalnum():
            start = i if start < 0 else start
        elif start >= 0:
            out.append((start, i))
            start = -1
    return [*out, (start, len(text))] if start >= 0 else out


def hit_spans(text: str, hits: np.ndarray) -> list[dict]:
    """Stretches of hit words as offsets in the original text."""
    at, out, last = word_offsets(text), [], -2
    for i in np.flatnonzero(hits):
        if i == last + 1:
            out[-1]["end"] = at[i][1]
        else:
            out.append({"start": at[i][0], "end": at[i][1]})
        last = i
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, size: int, max_nodes: int = MAX_NODES) -> Iterator[dict]:
    """Windows of the items, in blocks of bounded size; the items stream through the driver one partition at a time."""
    block: dict[tuple[bytes, ...], dict[str, None]] = {}
    nodes = 0
    for item in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        for w in windows_of(words_of(item[1]), size):
            if w not in block:
                if nodes + len(w) > max_nodes:
                    yield {k: list(v) for k, v in block.items()}
                    block, nodes = {}, 0
                block[w] = {}
                nodes += len(w)
            if item[0] is not None:
                block[w][item[0]] = None
    if block:
        yield {k: list(v) for k, v in block.items()}


def find(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, keep: list[str] | None = None, max_nodes: int = MAX_NODES, spans: bool = False
) -> DataFrame:
    """(doc, found): each row of ``docs`` as a struct (columns ``keep``, by default all), and n_words, n_hit, hits (a byte
    for each word; null if none is hit), items (ids of those that occur), spans (if asked for)."""
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    doc = T.StructType([docs.schema[c] for c in names])
    schema = T.StructType([T.StructField("doc", doc), T.StructField("text", T.StringType()), T.StructField(OUT, FOUND)])
    out = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs[text_col].alias("text"), F.lit(None).cast(FOUND).alias(OUT))
    blocks = blocks_of(benchmark, item_col, item_text, size, max_nodes)
    block = next(blocks, {})
    while block is not None:
        after = next(blocks, None)
        shipped, name = spark.sparkContext.broadcast(block), f"windows {uuid.uuid4().hex}"

        def run(batches, shipped=shipped, name=name, last=after is None):
            own = resident(name, lambda: Windows(shipped.value))
            for batch in batches:
                found = []
                for text, old in zip(batch.column(1), batch.column(2), strict=True):
                    text, old = text.as_py(), old.as_py()
                    words = words_of(text)
                    hits, items = own.scan(words)
                    if old is not None:
                        items |= set(old["items"])
                        if old["hits"] is not None:
                            was = np.frombuffer(old["hits"], bool)
                            hits = was if hits is None else hits | was
                    n = 0 if hits is None else int(hits.sum())
                    marked = hit_spans(text, hits) if spans and last and n else []
                    found.append({"n_words": len(words), "n_hit": n, "hits": hits.tobytes() if n else None, "items": sorted(items), "spans": marked})
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(found, _FOUND)], names=["doc", "text", OUT])

        out = out.mapInArrow(run, schema)
        block = after
        if block is not None:
            out = materialize(out, "found")
    return out.select("doc", F.col(OUT).alias("found"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: where benchmark passages stand in the original text, in characters. A column of that name
    is replaced."""
    rows = find(docs, benchmark, text_col, spans=True)
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c != "spans"], F.col("found.spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without any hit."""
    return find(docs, benchmark, text_col).filter("found.n_hit = 0").select("doc.*")
