"""Divergence of sources, hard negatives and odd sketches against brute force."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from cloudspark.llm import divergence, negatives, odd_sketch
from cloudspark.llm.common import materialize


def brute_divergence(rows, least_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))) for text, lang, source in rows]
    docs = Counter((lang, t) for lang, _, w in words for t in set(w))
    kept = {}
    for (lang, t), n in docs.items():
        if n >= least_docs:
            kept.setdefault(lang, set()).add(t)
    counts = {(lang, source): Counter() for lang, source, _ in words}
    for lang, source, w in words:
        counts[lang, source].update(t for t in w if t in kept.get(lang, ()))

    def shares(c, lang):
        v, n = len(kept.get(lang, ())), sum(c.values())
        return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept.get(lang, ())}

    out = set()
    for (lang, source), c in counts.items():
        p = shares(c, lang)
        q = shares(sum((x for (y, _), x in counts.items() if y == lang), Counter()), lang)
        pair = [(-sum(abs(p[t] - r[t]) for t in p), other.encode()) for (y, other), x in counts.items() if y == lang and other != source for r in [shares(x, lang)]]
        term = [(q[t] - p[t], t.encode()) for t in p if c[t] and p[t] > q[t]]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            out |= {(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:most])}
    return out


def test_divergence(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("été", "wort", "la", "Ünder", "zz") for b in "abcdefghijkl"] + ["x" * 300 + c for c in "abc"] + ["ties" + c for c in "abcdefgh"]
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 40))
        words = [vocabulary[int(k)] for k in rng.zipf(1.3, n) % len(vocabulary)]
        rows.append((" ".join(words).title() if i % 3 else "-".join(words), ["en", "de", None][i % 3], [None, "a", "é", "z", "alone"][int(rng.zipf(1.5)) % 5]))
    rows += [("ties" + c, "en", "a") for c in "abcdefgh"] * 3 + [("", "fr", "one"), (None, "fr", "two"), ("once", "it", "single")]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, n int").repartition(5)
    for least, top in ((3, 4), (1, 50), (10_000, 5)):
        got = [tuple(r) for r in divergence.audit(frame, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least, top)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_divergence_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"w{'abcdefghij'[int(k)]}" for k in rng.integers(0, 10, 6)), "en", f"s{i % 11}") for i in range(90)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(frame, 2, 3).collect()} == brute_divergence(rows, 2, 3)


def test_radix_select_takes_ties_by_bytes(spark):
    items = ["é", "e", "ea", "z" * 50, "z" * 49 + "a", "z" * 51, "", "日本"]
    rows = [("g", v, x) for v in (5, 5_000_000_000, 7) for x in items] + [("h", 0, "only")] + [("same", 3, "again")] * 9
    frame = materialize(spark.createDataFrame(rows, "g string, value long, item string"), "ranked")
    for k in (1, 3, 11, 20, 100):
        got = {(r.g, r.value, r.item, r["rank"]) for r in divergence.radix_select(frame, ["g"], "value", "item", k).collect()}
        want = set()
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]
            want |= {(*r, i + 1) for i, r in enumerate(own)}
        assert got == want


def brute_negatives(rows, every=100):
    valid = []
    for n, (vec_id, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            if vec_id is not None and vec_id % 7 == 0:
                label = (label + 1) % 10
            valid.append((n, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))

    def best(found):
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:5]

    out = []
    for n, anchor, label, a in valid:
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), i, lab) for m, i, lab, b in valid if m != n]
        for ps, pid, _ in best([x for x in scored if x[2] == label]):
            fit = best([x for x in scored if x[2] != label and 80 * ps <= 100 * x[0] <= 100 * ps])
            out += [(anchor, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_negatives(spark, scale):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 0.3, (40, 6)) * scale
    rows = []
    for i in range(700):
        kind = i % 9
        vector = [float(np.float32(x)) for x in (base[0] if i % 3 == 0 else base[int(rng.integers(40))] + rng.normal(0, 0.01, 6) * scale)]
        rows.append((i * 5 if kind else i * 50, vector[: 6 - (i % 50 == 7)], int(rng.integers(4))))
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 2), (500, [0.1] * 6, None), (None, base[0].tolist(), 1), (600, [], 1)]
    rows += rows[:40]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    want = brute_negatives(rows)
    for sizes in ({}, {"round_bytes": 600, "block_bytes": 200}):
        got = Counter(tuple(r) for r in negatives.mine(frame, **sizes).collect())
        assert got == want
    assert negatives.mine(frame.limit(0)).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(8)
    for most in (100, 1 << 24, 1 << 28):
        a, b = rng.integers(-most, most, (5, 4)), rng.integers(-most, most, (7, 3))
        assert negatives.products(a, b).astype(np.int64).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    with pytest.raises(ValueError):
        negatives.products(np.full((1, 2), 1 << 40), np.ones((1, 2), np.int64))


def brute_copies(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def copies(rng, n):
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for family in range(6):
        text = [words[int(k)] for k in rng.integers(0, 3000, 120)]
        for _ in range(n):
            own = list(text)
            for at in rng.integers(0, 120, int(rng.integers(0, 16))):
                own[at] = words[int(rng.integers(3000))]
            texts.append(" ".join(own))
    return texts


def test_odd_sketch(spark, monkeypatch):
    texts = copies(np.random.default_rng(9), 30)
    texts += texts[:5] + ["", None, " \t\n", "", "word", "WORD", "two words", "two  words", "Ä b", "ä b", "long " * 3000 + "end", "long " * 3000 + "end again"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(4)
    want = brute_copies(texts)
    assert {tuple(r) for r in odd_sketch.digest(frame).collect()} == want
    # one candidate a round, and bands in blocks
    monkeypatch.setattr(odd_sketch, "GROWTH", 2)
    found = odd_sketch.groups(frame, block=8)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()} == {r[:3] for r in want}
    assert odd_sketch.digest(frame.limit(0)).count() == 0


def test_odd_sketch_without_ids(spark):
    frame = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "d e f"), (None, "g h"), (None, None)], "doc_id long, text string")
    got = Counter(tuple(r) for r in odd_sketch.digest(frame).collect())
    assert got == Counter([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 1, None, True), (None, 0, None, True)])


def test_odd_sketch_estimates():
    """Sketches of pairs at the threshold are candidates, those of unlike pairs are none."""
    rng, seen = np.random.default_rng(10), []
    for shared, own in ((8000, 1000), (8000, 1000), (400, 50), (1000, 3000)):
        for _ in range(10):
            pool = rng.integers(0, 1 << 63, shared + 2 * own, np.uint64)
            a, b = pool[: shared + own], np.concatenate((pool[:shared], pool[shared + own :]))
            odd = [np.frombuffer(odd_sketch.odd_sketch(odd_sketch.samples(x)), np.uint64) for x in (a, b)]
            p = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
            seen.append((shared / (shared + 2 * own), 1 + 1024 / 512 * math.log(1 - 2 * p / 1024), p <= odd_sketch.most_odd()))
    assert all(fit for s, _, fit in seen if s >= 0.8) and not any(fit for s, _, fit in seen if s < 0.5)
    assert abs(np.mean([e - s for s, e, _ in seen if s >= 0.8])) < 0.02
