"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed here (protobuf wire format), and from it are rebuilt: the normaliser with the metaspace
marker and dummy prefix, the unigram scores or the BPE merges in the order of the scores, byte fallback, and the
decoder. Batches are encoded by the library's threads. ``parity`` holds ids against the sentencepiece library.

Defined results: a null text counts as empty and has no ids; texts of any length are encoded whole, in batches of
bounded characters; strings of control tokens in a text are ordinary text; rows with equal texts get equal ids; other
columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import resident

MARK = "▁"
#: Folder of the public tokenizers; a parameter of every function.
TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
#: Characters of text encoded at once.
BATCH_CHARS = 1 << 20
#: Bytes that one of a worker's two generations of memory may take, what a segment takes besides its text and ids, and
#: characters beyond which a segment is not remembered.
CACHE_BYTES, ENTRY_BYTES, CACHE_CHARS = 48 << 20, 220, 64
#: Words that are encoded as one text, and marks of segments that came once since memory was last full.
JOINED, SEEN = 32, 1 << 22
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True
    suffix: bool = False


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            m.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            m.kind, m.byte_fallback, m.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            m.suffix = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.one_space, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    known = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    out = []
    for i, (p, score, kind) in enumerate(m.pieces):
        if kind == NORMAL:
            out += [(-score, i, known[p[:k]], known[p[k:]]) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    return [(m.pieces[a][0], m.pieces[b][0]) for _, _, a, b in sorted(out)]


def build(data: bytes):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(data)
    unk = m.pieces[m.unk_id][0]
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    else:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.one_space:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARK if m.escape else " "
    if m.dummy_prefix and not m.suffix:
        steps.append(normalizers.Prepend(mark))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    # words can be encoded one by one if no piece goes on after a word's end
    if not any(a != mark and b == mark for p, _, kind in m.pieces if kind not in (CONTROL, UNKNOWN, BYTE) for a, b in zip(p, p[1:], strict=False)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{mark}*[^{mark}]+|{mark}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(mark, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED])
    return t


def normalise(m: Model, text: str) -> str:
    """What decoding gives back of ``text``: the text itself unless the model folds characters or blanks."""
    from tokenizers import normalizers

    if m.charsmap:
        text = normalizers.Precompiled(m.charsmap).normalize_str(text)
    return " ".join(x for x in text.split(" ") if x) if m.one_space else text


class Codec:
    """Encodes and decodes with a model.

    Where no piece goes on after a word's end, the ids of a text are those of its segments (a run of marks and the
    word after it), so a segment that is remembered is not encoded again. Memory has two generations of CACHE_BYTES.
    """

    def __init__(self, data: bytes) -> None:
        import re

        self.model, self.tokenizer = parse(data), build(data)
        self.data, self.cache, self.older, self.held, self.wrong = data, {}, {}, 0, set()
        self.separable = self.tokenizer.pre_tokenizer is not None and self.model.escape and not self.model.suffix
        if self.separable:  # segments are normalised and split before; decoding does without either
            self.tokenizer.normalizer = self.tokenizer.pre_tokenizer = None
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        kinds = [k for _, _, k in self.model.pieces]
        self.table = [bytes([int(x[3:5], 16)]) if i < len(kinds) and kinds[i] == BYTE else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.begins = np.array([x.startswith(MARK) for x in names], bool)
        self.seen = bytearray(SEEN)
        self.other = None
        #: Whether segments are remembered that were not compared.
        self.unverified = False

    def reference_ids(self, texts: list[str]) -> list[list[int]]:
        import sentencepiece

        if self.other is None:
            self.other = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self.other.encode(texts, num_threads=1)

    def encode(self, texts: list[str], verify: bool = False) -> list[tuple[bytes, bool]]:
        """For each text its ids as 32-bit little-endian bytes and whether they agree with the sentencepiece library.

        Without ``verify`` nothing is compared and the flag is true. What was encoded so is forgotten before anything is
        verified: a remembered segment has been compared.
        """
        if verify and self.unverified:
            self.cache, self.older, self.held = {}, {}, 0
        self.unverified = not verify
        if not self.separable:
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            same = [a == b for a, b in zip(own, self.reference_ids(texts), strict=True)] if verify else [True] * len(own)
            return [(np.asarray(x, "<i4").tobytes(), ok) for x, ok in zip(own, same, strict=True)]
        prefix = MARK if self.model.dummy_prefix else ""
        split = [self._split(prefix, normalise(self.model, x)) for x in texts]
        ids = self._ids(prefix, dict.fromkeys(chain.from_iterable(split), b""), verify)
        wrong = self.wrong
        return [(b"".join(map(ids.__getitem__, x)), not (wrong and not wrong.isdisjoint(x))) for x in split]

    def _ids(self, prefix: str, ids: dict[str, bytes], verify: bool) -> dict[str, bytes]:
        """``ids`` with those of its segments filled in: remembered ones, or new ones. What only the older generation has moves to the newer one."""
        missing = []
        for x in ids:
            y = self.cache.get(x)
            if y is None:
                y = self.older.get(x)
                if y is None:
                    missing.append(x)
                    continue
                self._remember(x, y)
            ids[x] = y
        if missing:
            own = self._new(prefix, missing)
            if verify:  # the library adds the mark itself; of an empty text it makes nothing
                self.wrong |= {x for x, a, b in zip(missing, own, self.reference_ids(missing), strict=True) if x and a != np.asarray(b, "<i4").tobytes()}
            for x, y in zip(missing, own, strict=True):
                ids[x] = y
                if len(x) <= CACHE_CHARS and self._worth(x):
                    self._remember(x, y)
        return ids

    def _new(self, prefix: str, segments: list[str]) -> list[bytes]:
        """Ids of each segment. Words of a BPE model are encoded JOINED at a time: each begins where a piece begins with a mark, and no
        merge crosses a word's end. Segments that have marks of their own, and all if some mark begins no piece, are encoded singly."""
        words = [x for x in segments if x and MARK not in x] if prefix and self.model.kind == BPE else []
        ids = self._packed([prefix + MARK.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])[0]
        at = (4 * np.flatnonzero(self.begins[ids])).tolist()
        if len(at) != len(words):
            words = at = []
        packed = ids.tobytes()
        known = {x: packed[i:j] for x, i, j in zip(words, at, [*at[1:], len(packed)], strict=False)}
        single = [x for x in segments if x not in known]
        ids, ends = self._packed([prefix + x for x in single])
        packed = ids.tobytes()
        known.update((x, packed[4 * i : 4 * j]) for x, i, j in zip(single, [0, *ends], ends, strict=False))
        return [known[x] for x in segments]

    def _packed(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts, one after the other, and where those of each end."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.fromiter(chain.from_iterable(own), "<i4"), list(accumulate(map(len, own)))

    def _worth(self, segment: str) -> bool:
        """Whether to remember a new segment: once memory has been full, only those that come again."""
        if not self.older:
            return True
        at = hash(segment) & (SEEN - 1)
        again, self.seen[at] = self.seen[at], 1
        return bool(again)

    def encode_whole(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """As ``encode``; each text is given to the sentencepiece library whole, whatever is remembered, and its ids compared with all."""
        return [(x, x == np.asarray(y, "<i4").tobytes()) for (x, _), y in zip(self.encode(texts), self.reference_ids(texts), strict=True)]

    def _split(self, prefix: str, text: str) -> list[str]:
        """Segments, each without the prefix."""
        if not text:
            return []
        if prefix and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        return [x.removeprefix(prefix) for x in self.segments(prefix + text.replace(" ", MARK))]

    def _remember(self, segment: str, ids: bytes) -> None:
        size = 2 * len(segment) + len(ids) + ENTRY_BYTES
        if self.held + size > CACHE_BYTES:
            self.older, self.cache, self.held, self.seen = self.cache, {}, 0, bytearray(SEEN)
        self.cache[segment] = ids
        self.held += size

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<i4").tolist()
        table = self.table
        try:
            text = b"".join([table[i] for i in numbers]).decode()
        except UnicodeDecodeError:  # bytes that are no text: as the library has it
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def parity(data: bytes, texts: list[str]) -> list[bool]:
    """For each whole text whether the ids equal those of the sentencepiece library."""
    codec = Codec(data)
    return [np.frombuffer(a, "<i4").tolist() == b for (a, _), b in zip(codec.encode(texts), codec.reference_ids(texts), strict=True)]


def read_model(path: str = f"{TOKENIZERS}/{MODEL}") -> bytes:
    """The model file, read on the driver; its size is bounded by its vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def _worker(data: bytes) -> Codec:
    """The codec of a worker process, built once."""
    return resident(f"codec {hashlib.sha256(data).hexdigest()}", lambda: Codec(data))


def _bounded(texts: list[str]) -> Iterator[slice]:
    """Slices of at most BATCH_CHARS characters or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def _rows(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*[df[c] for c in names]).alias("doc")


def _schema(df: DataFrame, names: list[str], more: str) -> T.StructType:
    return T.StructType([T.StructField("doc", T.StructType([df.schema[c] for c in names])), *T._parse_datatype_string(more)])


def encode(docs: DataFrame, text_col: str = "text", path: str = f"{TOKENIZERS}/{MODEL}", verify: bool = False) -> DataFrame:
    """(doc, ids): the row as a struct and an array of token ids. ``verify`` adds ``parity``, whether the sentencepiece library makes the
    same of the whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        codec = _worker(shipped.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for s in _bounded(texts):  # a batch for each slice, so that few ids are held at once
                found = (codec.encode_whole if verify else codec.encode)(texts[s])
                ids = [np.frombuffer(x, "<i4") for x, _ in found]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                more = {"parity": pa.array([same for _, same in found], pa.bool_())} if verify else {}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), column, *more.values()], names=["doc", "ids", *more])

    schema = "ids array<int>, parity boolean" if verify else "ids array<int>"
    return docs.select(_rows(docs, docs.columns), docs[text_col].alias("text")).mapInArrow(run, _schema(docs, docs.columns, schema))


def decode(rows: DataFrame, ids_col: str = "ids", path: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """(doc, decoded): the row as a struct and the text of its ids."""
    shipped = rows.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        codec = _worker(shipped.value)
        for batch in batches:
            texts = [codec.decode(np.asarray(x or [], "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "decoded"])

    return rows.select(_rows(rows, rows.columns), rows[ids_col].alias("ids")).mapInArrow(run, _schema(rows, rows.columns, "decoded string"))


def check(docs: DataFrame, text_col: str = "text", path: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """(doc, n_tokens, ids_sha256 (of 32-bit little-endian ids), round_trip, parity): the row as a struct without its text. Parity is that of whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_model(path))
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "round_trip": pa.bool_(), "parity": pa.bool_()}

    def run(batches):
        codec = _worker(shipped.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out: list[tuple] = []
            for s in _bounded(texts):
                for text, (ids, same) in zip(texts[s], codec.encode_whole(texts[s]), strict=True):
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), codec.decode(ids) == normalise(codec.model, text), same))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], names=["doc", *kinds])

    names = [c for c in docs.columns if c != text_col]
    schema = _schema(docs, names, "n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")
    return docs.select(_rows(docs, names), docs[text_col].alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, round_trip, parity."""
    return check(docs.select("doc_id", "text")).select("doc.doc_id", "n_tokens", "ids_sha256", "round_trip", "parity")
