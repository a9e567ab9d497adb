"""Personal data: base rules and a skip-chain conditional random field.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers. The field labels the tokens of a
document that hold a digit or an ``@``; all other tokens are outside. Neighbours share a transition potential, and
tokens that repeat or differ only in punctuation share a skip potential with the next such token, so the number of
edges is linear. Loopy belief propagation runs over several documents at once until its messages settle. Tokens that the field labels
with enough certainty, that have the form of their label and that touch no base span are added.

Training is piecewise on silver labels from the base rules, over about SAMPLE distinct texts chosen by a hash: node
potentials by multinomial logistic regression on token shapes, edge potentials from pair counts.

Defined results: a null text counts as empty; offsets count code points; rules run in time linear in the text; an
empty corpus trains a field that labels nothing; rows with equal texts get equal results; other columns, whatever
their names, pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0  # labels are 0 and 1 + the place in KINDS
LABELS = 1 + len(KINDS)
#: Documents with candidates that the field is trained on, about.
SAMPLE = 4_000
FEATURES = 1 << 12
#: Message passing ends when no message changes by more than SETTLED, or after so many rounds: loops may swing.
ROUNDS, DAMPING, SETTLED = 100, 0.3, 1e-4
#: Nodes whose messages are in memory at once, unless one document has more.
NODES = 50_000
LEAST_BELIEF = 0.8
Span = tuple[int, int, int]  # start, place in KINDS, end

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_local = re.compile(r"[A-Za-z0-9._%+-]").match
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[0-9]").findall
_hint = re.compile(r"[0-9@]").search
_token = re.compile(r"[^\x20\x09-\x0d]+").finditer


def luhn(digits: list[str]) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the base rules, by start, then kind."""
    if not _hint(text):
        return []
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        if m := _domain(text, at + 1):
            start = at
            while start > free and _local(text, start - 1):
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _card(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _ip(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Digits by run length, letters as one sign each run, other characters as they are."""
    size = lambda m: f"9{min(len(m[0]), 4) if len(m[0]) < 5 else 7 if len(m[0]) < 8 else 11 if len(m[0]) < 12 else 19 if len(m[0]) < 20 else 20}"
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", size, token))


@dataclass
class Token:
    start: int
    end: int
    place: int  # among all tokens of the text
    shape: str
    before: str
    after: str
    key: str


def candidates(text: str) -> list[Token]:
    """Tokens with a digit or an @, without the punctuation around them."""
    if not _hint(text):
        return []
    out: list[Token] = []
    last, waiting = "", None
    for place, m in enumerate(_token(text)):
        word = m[0]
        if _hint(word):
            core = word.strip("\"'`,;:.!?*#$&|<>[]{}=%/\\")
            if _hint(core):
                start = m.start() + word.index(core)
                form = shape(core)
                if waiting:
                    waiting.after = form
                waiting = Token(start, start + len(core), place, form, last, "", re.sub(r"[\W_]+", "", core).lower())
                out.append(waiting)
                last = form
                continue
        last = "a" if word.isalpha() else shape(word)
        if waiting:
            waiting.after, waiting = last, None
    return out


def labels_of(tokens: list[Token], spans: list[Span]) -> list[int]:
    """The label of each token: the kind of a base span that it touches, or outside."""
    out, i = [], 0
    for t in tokens:
        while i < len(spans) and spans[i][2] <= t.start:
            i += 1
        out.append(next((1 + k for s, k, e in spans[i : i + 4] if s < t.end and t.start < e), OUTSIDE))
    return out


def edges_of(tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbours; each token and the next with the same key."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1].place == tokens[i].place + 1]
    skip, last = [], {}
    for i, t in enumerate(tokens):
        if (j := last.get(t.key)) is not None and (j < i - 1 or t.place != tokens[j].place + 1):  # neighbours have an edge
            skip.append((j, i))
        last[t.key] = i
    return chain, skip


def features(t: tuple[str, str, str]) -> list[int]:
    own, before, after = t
    marks = f"{own.count('.')}{'@' in own}{own[:1]}{own[-1:]}{len(own) // 3}"
    names = ("o" + own, "b" + before + "|" + own, "n" + own + "|" + after, "p" + before, "s" + after, "m" + marks)
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=4).digest()) % FEATURES for x in names]


@dataclass
class Field:
    weights: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray  # LABELS x LABELS, log potentials
    skip: np.ndarray


def train(shapes: Counter, chain: np.ndarray, skip: np.ndarray) -> Field:
    """shapes: ((own, before, after), label) and how often. chain, skip: label pairs and how often."""
    weights = np.zeros((FEATURES, LABELS))
    weights[:, OUTSIDE] = 0.5
    inside, whole = Counter(), Counter()
    for (key, kind), n in shapes.items():
        whole[key[0]] += n
        inside[key[0]] += n * (kind != OUTSIDE)
    # a token outside whose shape is mostly inside elsewhere may be one that the rules missed: no example of either
    shapes = Counter({k: n for k, n in shapes.items() if k[1] != OUTSIDE or 2 * inside[k[0][0]] < whole[k[0][0]]})
    if shapes:
        x = np.array([features(k[0]) for k in shapes])
        y = np.eye(LABELS)[[k[1] for k in shapes]]
        n = np.array(list(shapes.values()), float)[:, None]
        rate = 2.0 / n.sum()
        square = np.full(weights.shape, 1e-8)
        for _ in range(150):
            z = weights[x].sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros_like(weights)
            np.add.at(g, x, np.repeat(((p - y) * n * rate)[:, None], x.shape[1], 1))
            g += 1e-4 * weights
            square += g * g
            weights -= 0.3 * g / np.sqrt(square)
    def pairs(c: np.ndarray) -> np.ndarray:
        joint = (c + 0.5) / (c + 0.5).sum()
        return np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -3, 3)
    # how often a repeat has the label of the one before it, by label; silver labels miss what the rules miss, so that
    # repeats agree more often than they show: a prior of 19 in 20
    both = skip + skip.T
    agree = (np.diag(both) + 19) / (both.sum(1) + 20)
    return Field(weights, pairs(chain), np.diag(np.clip(np.log(agree / (1 - agree)), 0.5, 4)))


def beliefs(field: Field, nodes: np.ndarray, chain: np.ndarray, skip: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product. nodes: features. fixed: label of nodes known from a base span, or -1."""
    unary = field.weights[nodes].sum(1)
    unary -= np.logaddexp.reduce(unary, 1)[:, None]
    known = fixed >= 0
    unary[known] = -20
    unary[known, fixed[known]] = 0
    a = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]]).astype(np.int64)
    b = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]]).astype(np.int64)
    half, c = len(a) // 2, len(chain)
    # from a's label to b's; edges of one kind and direction share a matrix
    kinds = [(slice(0, c), field.chain), (slice(c, half), field.skip), (slice(half, half + c), field.chain.T), (slice(half + c, 2 * half), field.skip.T)]
    kinds = [(at, np.exp(m)) for at, m in kinds]
    message = np.zeros((2 * half, LABELS))
    reverse = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    for _ in range(ROUNDS if half else 0):
        total = unary.copy()
        np.add.at(total, b, message)
        sent = total[a] - message[reverse]
        sent = np.exp(sent - sent.max(1, keepdims=True))
        for at, m in kinds:
            sent[at] = sent[at] @ m
        sent = DAMPING * message + (1 - DAMPING) * np.log(sent / sent.sum(1, keepdims=True))
        change, message = np.abs(np.exp(sent) - np.exp(message)).max(), sent
        if change < SETTLED:
            break
    total = unary
    np.add.at(total, b, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def has_form(text: str, kind: int) -> bool:
    """Whether an added span can be of its kind."""
    digits = len(_digits(text))
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(int(x) <= 255 for x in text.split("."))
    if kind == 2:
        return 12 <= digits <= 19 and not re.search(r"[^0-9 .-]", text) and luhn(_digits(text))
    return 7 <= digits <= 15 and not re.search(r"[^0-9 .()+/-]", text)


def label(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text, for as many texts at once as have NODES tokens, about."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += 1 + sum(map(text.count, "0123456789@")) // 4
        if size >= NODES:
            out += _label(field, part)
            part, size = [], 0
    return out + _label(field, part)


def _label(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    base = [base_spans(x) for x in texts]
    nodes: list[list[int]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    fixed: list[int] = []
    found: list[tuple[int, list[Token], list[int]]] = []
    memo: dict[tuple[str, str, str], list[int]] = {}
    for i, text in enumerate(texts):
        tokens = candidates(text)
        known = labels_of(tokens, base[i])
        if OUTSIDE not in known:
            continue
        at = len(nodes)
        a, b = edges_of(tokens)
        chain += [(at + x, at + y) for x, y in a]
        skip += [(at + x, at + y) for x, y in b]
        for t, k in zip(tokens, known, strict=True):
            key = (t.shape, t.before, t.after)
            if key not in memo:
                memo[key] = features(key)
            nodes.append(memo[key])
            fixed.append(k or -1)
        found.append((i, tokens, known))
    more: list[list[Span]] = [[] for _ in texts]
    if nodes:
        p = beliefs(field, np.array(nodes), np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2), np.array(fixed))
        best, sure = p.argmax(1), p.max(1) >= LEAST_BELIEF
        at = 0
        for i, tokens, known in found:
            spans: list[list[int]] = []
            last = None
            for j, (t, k) in enumerate(zip(tokens, known, strict=True)):
                kind = int(best[at + j])
                if k or not kind or not sure[at + j]:
                    continue
                if last and last[0] == t.place - 1 and last[1] == kind:
                    spans[-1][2] = t.end
                else:
                    spans.append([t.start, kind - 1, t.end])
                last = (t.place, kind)
            more[i] = [(s, k, e) for s, k, e in spans if has_form(texts[i][s:e], k)]
            at += len(tokens)
    return list(zip(base, more, strict=True))


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """Train on about SAMPLE of the documents with candidates."""
    text = F.col(text_col)
    hinted = docs.filter(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), text.alias("text"))
    every = max(1, hinted.agg(F.approx_count_distinct("h")).first()[0] // SAMPLE)  # of distinct texts, each once

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                tokens = candidates(x.as_py())
                own = labels_of(tokens, base_spans(x.as_py()))
                seen.update(((t.shape, t.before, t.after), k, -1) for t, k in zip(tokens, own, strict=True))
                for kind, edges in zip(("\tchain", "\tskip"), edges_of(tokens), strict=True):
                    seen.update(((kind, "", ""), own[i], own[j]) for i, j in edges)
        cols = [[k[0][0] for k in seen], [k[0][1] for k in seen], [k[0][2] for k in seen], [k[1] for k in seen], [k[2] for k in seen], list(seen.values())]
        kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["own", "prev", "next", "a", "b", "n"])

    rows = (
        hinted.filter(F.pmod("h", F.lit(every)) == 0)
        .dropDuplicates(["h"])
        .select("text")
        .mapInArrow(run, "own string, prev string, next string, a int, b int, n long")
        .groupBy("own", "prev", "next", "a", "b")
        .agg(F.sum("n").alias("n"))
        .orderBy("own", "prev", "next", "a", "b")
        .collect()
    )
    shapes: Counter = Counter()
    pairs = {"\tchain": np.zeros((LABELS, LABELS)), "\tskip": np.zeros((LABELS, LABELS))}
    for x in rows:
        if x.own in pairs:
            pairs[x.own][x.a, x.b] += x.n
        else:
            shapes[(x.own, x.prev, x.next), x.a] += x.n
    return train(shapes, pairs["\tchain"], pairs["\tskip"])


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)


def find(docs: DataFrame, field: Field, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc, spans): the row as a struct; start, kind, end and whether a base rule found it; by start, then kind as in KINDS."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    names = [c for c in docs.columns if keep_text or c != text_col]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            out = []
            for base, more in label(shipped.value, [x.as_py() or "" for x in batch.column(1)]):
                both = sorted([*((*s, True) for s in base), *((*s, False) for s in more)])
                out.append([{"start": s, "kind": KINDS[k], "end": e, "base": b} for s, k, e, b in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc", "spans"])

    schema = T.StructType([T.StructField("doc", T.StructType([docs.schema[c] for c in names])), T.StructField("spans", SPANS)])
    return docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs[text_col].alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    docs = docs.select("doc_id", "text")
    rows = find(docs, fit(docs), keep_text=False)
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return rows.select(
        "doc.doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )
