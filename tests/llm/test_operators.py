"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and clashing names."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloudspark.llm import components, decontaminate, exact_dedup, hmm, kneser_ney, line_dedup, pii_crf, secret_scan, simhash, sp_codec, wrappers

random.seed(7)
WORDS = ["".join(random.choices("abcdeé", k=random.randint(1, 6))) for _ in range(300)]
BASE = [" ".join(random.choices(WORDS, k=random.randint(3, 80))) for _ in range(40)]
TEXTS = [None, "", "", "One", " \n ", "x " * 30_000, *BASE, *BASE[:5], BASE[6] + " more", "token = \"" + "0123456789abcdef" * 3 + "\""]
SCHEMA = "doc_id long, text string, source string, lang string, word string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 9}" if i % 11 else None, "en" if i % 3 else None, "w", True) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id", "s1", "en", None, None)], SCHEMA)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_exact_dedup(docs):
    T = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decide(docs).collect()}
    by = collections.defaultdict(list)
    for i, t in T:
        by[t].append(i)
    top = {t: max((x for x in v if x is not None), default=None) for t, v in by.items()}
    assert got == {(i, top[t], len(by[t]), i == top[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in T}
    assert exact_dedup.deduplicate(docs).count() == len(by)
    hashed = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    for cells, words in ((64, 1 << 20), (1, 4), (64, 4)):  # also so small that most cells are shared
        rows = exact_dedup.flag_possible_repeats(hashed, cells, 2, words).groupBy("text_sha256").agg(F.min("maybe").alias("maybe"), F.count("*").alias("n")).collect()
        assert all(r.maybe for r in rows if r.n > 1)
    assert sum(r.maybe for r in exact_dedup.flag_possible_repeats(hashed).collect()) < docs.count()
    assert exact_dedup.decide(docs.limit(0)).count() == 0


def test_simhash(docs):
    T = texts_of(docs)
    rows = simhash.digest(docs).collect()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), T[r.doc_id]))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows if r.doc_id is not None}
    part = {i: i for i in fp}
    for _ in range(8):
        for i in fp:
            part[i] = min(part[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
    assert part == {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert simhash.digest(docs.limit(0)).count() == 0
    text_ids = docs.select(F.col("doc_id").cast("string"), "text")
    assert simhash.digest(text_ids).schema["component_id"].dataType.simpleString() == "string" and simhash.digest(text_ids).count() == docs.count()


def test_large_shards_are_split_without_loss(spark):
    rng = random.Random(9)
    near = [0]
    for _ in range(300):  # many fingerprints that share blocks, in chains
        near.append(rng.choice(near) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted({x - (1 << 64) if x >> 63 else x for x in [*near, *(rng.getrandbits(16) << 48 for _ in range(300))]})
    table = simhash.materialize(spark.createDataFrame([(v,) for v in values], "fp long"), "fps")
    want = {v: v for v in values}
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    for _ in range(40):
        new = {v: min(want[u] for u in values if far(u, v) <= 3) for v in values}
        if new == want:
            break
        want = new
    for rows in (1 << 20, 8):
        found = {r.node: r.root for r in components.components(simhash.links(simhash.shards(table, split_rows=rows))).collect()}
        assert {v: found.get(v, v) for v in values} == want


def test_forest_connects_what_brute_force_connects():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(30)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(4)]
    got = {v: v for v in values}
    for a, b in simhash.forest(values):
        got[b] = a
    part = {v: v for v in values}
    for _ in range(10):
        for v in values:
            part[v] = min(part[u] for u in values if (u ^ v).bit_count() <= 3)
    assert got == part


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontamination(spark, docs):
    items = [(1, " ".join(BASE[3].split()[:14]).upper()), (2, "nothing like it anywhere in here"), (None, "x y"), (4, None), (5, "one"), (1, BASE[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(str(i) if i is not None else None, tuple(w[k : k + 10])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    T = texts_of(docs)
    for r in decontaminate.digest(docs, bench).collect():
        w = words(T[r.doc_id])
        hit, own = set(), set()
        for i, win in wins:
            if win[0] in w:
                for k in range(len(w) - len(win) + 1):
                    if w[k] == win[0] and tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        own |= {i} - {None}
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(own))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    whole, blocks = ({(r.doc.doc_id, r.found.n_hit, *r.found["items"]) for r in decontaminate.find(docs, bench, max_nodes=n).collect()} for n in (1 << 20, 25))
    assert whole == blocks
    assert decontaminate.digest(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    row = decontaminate.spans(docs.filter("doc_id = 3"), bench).first()
    assert [row.text[s.start : s.end] for s in row.spans] == ["One"]


def test_secrets(docs, spark):
    more = spark.createDataFrame([(900, 'é PASSWORD: "abcdefg" api-key=x api_key = ab tokEN=12345 AKIA' + "Z9" * 9 + " uuid 123e4567-e89b-12d3-a456-426614174000 k q7Rz2Lw9Xv4Tn8Bm3Kp6Jd1")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    T = texts_of(rows)
    rules = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for r in secret_scan.digest(rows).collect():
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in p.finditer(T[r.doc_id]) if len(m[g]) >= n)
        text = ",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        if r.doc_id == 900:
            assert r.n_entropy == 1


def test_secrets_of_one_letter_case_with_separators(spark):
    keys = ["key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "Q7RZ2-LW9XV-4TN8B-M3KP6-JD1HF", "sample/q7Rz2Lw9Xv4Tn8Bm3Kp6Jd1"]
    rows = [*enumerate(f"see {k} here" for k in keys), (12, "see 2024-01-01-2024-01-02-2024 here"), (14, "see how-to-build-a-quiet-house-in-2024 here"), (15, "see your_example-key-0000-1234567-abcdefg here"), (13, "see 123e4567-e89b-12d3-a456-426614174000 here")]
    got = {r.doc_id: r.spans for r in secret_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: f"entropy:4:{4 + len(k)}" for i, k in enumerate(keys)}, **dict.fromkeys((12, 13, 14, 15), "")}


def test_window_entropy(spark):
    from pyspark.sql import functions as F

    rng, signs = random.Random(4), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    strings = ["a" * 25, "q7Rz2Lw9Xv4Tn8Bm3Kp6Jd1", "abcdefghijklmnopqrst", "aab" * 9]
    strings += ["".join(rng.choices(signs[:k], k=n)) for k in (2, 5, 16, 67) for n in (20, 21, 40, 700)]
    want = [max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)) for s in strings]
    rows = spark.createDataFrame(list(zip(strings, want, strict=True)), "s string, want double")
    assert rows.filter(F.abs(secret_scan.max_entropy(F.col("s")) - F.col("want")) > 1e-9).count() == 0


def test_long_candidates_take_linear_time(spark):
    import time

    def run(n):
        text = "see " + "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", k=n))
        table = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").coalesce(1)
        began = time.time()
        assert {r.spans for r in secret_scan.digest(table).collect()} == {f"entropy:4:{4 + n}", ""}
        return time.time() - began

    run(20_000)
    assert run(300_000) < 60 and secret_scan.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def line_copies(rows, sites):
    """Brute force: hashes of the texts that are left."""
    home = {}
    for _, text, site in rows:
        if text is not None and site is not None:
            home[text] = min(home.get(text, site), site)
    strip = lambda x: x.strip(" \t\r\v\f")
    lines = {t: [x for x in map(strip, t.split("\n")) if x] for _, t, _ in rows if t is not None}
    seen = collections.defaultdict(set)
    for text, site in home.items():
        for x in lines[text]:
            seen[x].add(site)
    often = {x for x, own in seen.items() if len(own) >= sites}
    groups = collections.defaultdict(set)
    for text, own in lines.items():
        held = [x for x in own if x in often]
        copied = 2 * len(held) > len(own) and 2 * sum(map(len, held)) > sum(map(len, own))
        for x in held:
            groups[x].add(min(hashlib.md5(y.encode()).hexdigest() for y in held) if copied else "text " + text)
    bad = {x for x, own in groups.items() if len(own) >= sites}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if strip(x) not in bad) for i, t, _ in rows}


def test_lines(spark):
    """Lines on fewer sites, as many, and far more; short ones; repeats in a text; copies and near copies of one text on many
    sites; texts that have little else than such lines, with and without others that have them."""
    line = "all rights reserved by us"
    rows = [(i, f"text number {i} is here and has a good deal to say\n{line}\r\nLes.\n \n{'many' if i < 40 else 'few'}\nLes.\nend {i}", f"s{i % 23}") for i in range(60)]
    rows += [(600 + i, f"{i}\n{line}\nonly in short texts of this kind", f"s{i}") for i in range(12)]
    whole = [f"line {k} of a text that many copy" for k in range(9)]
    rows += [(700 + i, "\n".join([*whole[: i % 9], f"changed {i}", *whole[i % 9 + 1 :]]), f"s{i % 11}") for i in range(40)]
    rows += [(100 + i, f"own {i}\nexactly eight\n\t", f"s{i}") for i in range(8)] + [(200 + i, f"own again {i}\nonly seven", f"s{i}") for i in range(7)]
    rows += [(300 + i, "one whole text\non many sites", f"s{i}") for i in range(20)] + [(400, line, "s1"), (401, None, None), (402, "", "s2"), (403, line, None), (404, "x\n" * 20_000 + line, "s3")]
    rows += [(500 + i, "few\nno site", None) for i in range(20)]
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, source string, at string, key string, line string, n string")
    got = {r.doc.doc_id: r.text for r in line_dedup.remove(table).collect()}
    assert got == line_copies(rows, 8)
    assert {r.doc_id: r.text_sha256 for r in line_dedup.digest(table).collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in got.items()}
    assert line_dedup.digest(table.limit(0)).count() == 0


def test_pipeline_removes_short_lines(spark):
    """Lines of few words, without blanks or divided by tabs stand on many sites like any other; white space does not count."""
    import corpus_pipeline

    often = ["All rights reserved.", "版権所有無断転載を禁じます", "one\ttwo\tthree", "Les."]
    body = "{0} a long body of its own {0} with a number {0} and what else a document of some length says {0} to its readers {0}"
    own = [body.format(i * 7919) for i in range(9)]
    rows = [(i, "\n".join([often[0], t, " ", "\r", *often[1:]]), f"s{i}", 0) for i, t in enumerate(own)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), "").collect()
    assert {r.doc_id: r.text for r in got} == {i: f"{t}\n \n\r" for i, t in enumerate(own)}


def test_pipeline_leaves_no_text_with_boilerplate(spark):
    """A short text loses a long foot; copies and near copies of one text on many sites keep what they share."""
    import corpus_pipeline

    rng = random.Random(13)
    foot = "this foot is far longer than what stands above it and comes on every site there is"
    own = [f"own line {i}" for i in range(12)]
    whole = "\n".join(" ".join(f"v{rng.randrange(5000)}" for _ in range(30)) for _ in range(6))
    texts = [f"{t}\n{' '.join(f'w{rng.randrange(5000)}' for _ in range(12))}\n{foot}" for t in own] + [whole] * 9 + [f"{whole}\nseen on {i}" for i in range(9)]
    table = spark.createDataFrame([(i, t, f"s{i % 10}", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, table, "").collect()}
    assert got == {i: t.removesuffix("\n" + foot) for i, t in enumerate(texts)}


def test_hmm(docs):
    import zlib

    T = texts_of(docs)
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    c = collections.Counter()
    for i, t in T.items():
        if crc(i) != 2:
            c.update([*hmm.tokens(t), b"\n"])
    n, v = sum(c.values()), len(c)
    for r in hmm.digest(docs).collect():
        w = [*hmm.tokens(T[r.doc_id]), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, crc(r.doc_id) == 2)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert r.score < 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    m = hmm.Model(*(x.astype(np.float32) for x in (rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)))
    texts = [rng.integers(0, 5, k) for k in (1, 4, 3)]
    import itertools

    for x, got in zip(texts, hmm.log_likelihood(m, texts), strict=True):
        total = sum(m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, q] for s, q in zip(x, p)]) for p in itertools.product(range(3), repeat=len(x)))
        assert abs(got - math.log10(total)) < 1e-4


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(1)
    texts = [np.repeat(rng.integers(0, 2), 6) * 3 + rng.integers(0, 3, 6) for _ in range(50)]
    share = np.full(6, 1 / 6)
    model = hmm.maximise(hmm.Model(np.ones(8), np.ones((8, 8)), rng.random((6, 8)) * 1e4), share)
    first = hmm.log_likelihood(model, texts).sum()
    for _ in range(5):
        model = hmm.maximise(hmm.expected(model, texts), share)
    assert hmm.log_likelihood(model, texts).sum() > first


def kneser_ney_model(texts):
    """Brute force with plain dictionaries: probability of a symbol after three others."""
    seen = {4: collections.Counter()}
    for t in texts:
        own = ["^"] * 3 + list(t or "") + ["$"]
        seen[4].update(tuple(own[i : i + 4]) for i in range(len(own) - 3))
    for k in (3, 2, 1):
        seen[k] = collections.Counter(g[1:] for g in seen[k + 1])
    cut = {k: [0, *kneser_ney.discounts(collections.Counter(c.values()))] for k, c in seen.items()}
    after = {k: collections.defaultdict(dict) for k in seen}
    for k, c in seen.items():
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    def p(context, x):
        lower = p(context[1:], x) if context else 1 / (len(seen[1]) + 1)
        own = after[len(context) + 1].get(context)
        if not own:
            return lower
        d, total, n = cut[len(context) + 1], sum(own.values()), own.get(x, 0)
        return (n - d[min(n, 3)] + sum(d[min(m, 3)] for m in own.values()) * lower) / total

    return p, {x for (x,) in seen[1]}


def test_kneser_ney(spark, docs):
    """Against plain dictionaries, with all grams broadcast, some of them and nearly none; probabilities sum to one."""
    trained = [t for t in BASE[:12]] + [None, "ß日本 日本"]
    p, alphabet = kneser_ney_model(trained)
    for context in [("^",) * 3, ("^", "^", "a"), ("a", "b", " "), ("z", "z", "z"), ("日", "本", " ")]:
        assert abs(sum(p(context, x) for x in alphabet) + p(context, "unknown") - 1) < 1e-9
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in trained], "text string"))
    few = docs.filter("doc_id <> 5 OR doc_id IS NULL")
    want = {}
    for i, t in texts_of(few).items():
        own = ["^"] * 3 + list(t) + ["$"]
        want[i] = sum(math.log(p(tuple(own[k : k + 3]), own[k + 3])) for k in range(len(t) + 1))
    for hot, bits in ((kneser_ney.HOT, 1 << 16), (300, 1 << 16), (1, 64)):
        rows = kneser_ney.score(few, model, hot=hot, cold_bits=bits).collect()
        assert all(abs(r.ln_p - want[r.doc.doc_id]) < 1e-6 * (1 + abs(r.ln_p)) and r.chars == len(r.doc.text or "") + 1 for r in rows)
        assert len(rows) == few.count() and set(rows[0].doc.asDict()) == set(docs.columns)
    nothing = kneser_ney.fit(spark.createDataFrame([], "text string"))
    assert all(r.ln_p < 0 for r in kneser_ney.score(few, nothing).collect())


def test_table_of_keys():
    rng = np.random.default_rng(5)
    key, value = np.unique(rng.integers(0, 1 << 63, 5_000, np.uint64) & np.uint64(0xFFFF0000000001FF)), rng.random(5_000)
    table = kneser_ney.Table(key, value[: len(key)])
    got, found = table.find(np.concatenate([key, key + np.uint64(1 << 20)]))
    assert found[: len(key)].all() and not found[len(key) :].any() and (got[: len(key)] == value[: len(key)]).all() and not got[len(key) :].any()


def test_quality(spark):
    rows = [(i, " ".join(random.choices(["the", "of", "and", "lines", "water"], k=60)), "en") for i in range(80)]
    rows += [(100, "Q#Z%" * 80, "en"), (101, "Q#Z%" * 80, None), (102, None, "en"), (103, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(60)), (None, 1, 0), (100, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in kneser_ney.digest(docs, labels).collect()}
    assert got == {r[0]: r[0] != 100 for r in rows}
    assert all(r.accepted for r in kneser_ney.digest(docs, labels.limit(0)).collect())
    assert kneser_ney.digest(docs.limit(0), labels).count() == 0
    clash = docs.withColumn("of", docs["lang"]).withColumn("cold", docs["lang"]).withColumn("row", docs["lang"])
    assert set(kneser_ney.classify(clash, labels).select("doc.*").columns) == set(clash.columns)


def test_sentencepiece(docs):
    import sentencepiece

    data = sp_codec.read_model()
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    T = texts_of(docs)
    rows = sp_codec.decode(sp_codec.encode(docs)).collect()
    assert len(rows) == docs.count() and sp_codec.digest(docs.limit(0)).count() == 0
    for r in rows:
        assert list(r.doc["ids"]) == other.encode(T[r.doc.doc.doc_id]) and r.decoded == T[r.doc.doc.doc_id]
    assert all(r.round_trip and r.parity for r in sp_codec.digest(docs).collect())
    assert all(sp_codec.parity(data, ["", " ", "a  b ", "<s> x", "\x00\n日本 🙂", "▁", "▁▁a"]))


def message(*parts):
    """A protobuf message of (number, value): bytes, text, float or int."""
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def test_unigram_model_with_byte_fallback(spark, tmp_path):
    """Scores written by hand, no training: ids equal those of the sentencepiece library, and decode to the text."""
    import sentencepiece

    rng = random.Random(2)
    pieces = [("<unk>", 0.0, sp_codec.UNKNOWN), ("<s>", 0.0, sp_codec.CONTROL), ("</s>", 0.0, sp_codec.CONTROL)]
    pieces += [(f"<0x{i:02X}>", 0.0, sp_codec.BYTE) for i in range(256)]
    own = {x for w in WORDS for i in range(len(w)) for j in range(i + 1, len(w) + 1) for x in (w[i:j], sp_codec.MARK + w[:j])} | {sp_codec.MARK, *"abcdeé"}
    pieces += [(x, -rng.uniform(1, 14) - len(x), sp_codec.NORMAL) for x in sorted(own)]
    spec = message((3, sp_codec.UNIGRAM), (35, 1), (40, 0))
    data = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces) + message((2, spec), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["", "a", " a  b", "日本 🙂 x\n", *BASE[:20]]
    codec = sp_codec.Codec(data)
    got = [np.frombuffer(x, "<i4").tolist() for x, _ in codec.encode(texts)]
    assert got == [other.encode(x) for x in texts] and all(ok for _, ok in codec.encode(texts, verify=True))
    assert [codec.decode(np.array(x, "<i4").tobytes()) for x in got] == texts
    (tmp_path / "unigram.model").write_bytes(data)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.parity and r.round_trip for r in sp_codec.check(table, path=str(tmp_path / "unigram.model")).collect())


def test_memory_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE_BYTES", 20_000)
    codec = sp_codec.Codec(sp_codec.read_model())
    texts = [" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(40)] + ["z" * 100_000]
    first = [x for x, _ in codec.encode(texts)]
    assert [x for t in texts for x, _ in codec.encode([t])] == first
    assert len(codec.cache) + len(codec.older) < 200 and max(map(len, codec.cache)) <= sp_codec.CACHE_CHARS


def test_pii_rules_and_field(spark):
    al = "a1@.+- (9%5"
    for _ in range(2000):
        t = "".join(random.choices(al, k=40))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.findall("[0-9]", m[0])
            if 12 <= len(d) <= 19 and pii_crf.luhn(d):
                want.append((m.start(), 2, m.end()))
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
        assert sorted(want) == pii_crf.base_spans(t)
    rows = [(i, f"call +1 (743) 555-38{i:02d} today") for i in range(60)] + [(100, "+1 (743) 555-3899 is (743) 555-3899"), (101, None), (102, "")]
    got = {r.doc_id: r for r in pii_crf.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    clash = spark.createDataFrame([(1, "see 10.0.0.1", "a", "b")], "doc_id long, text string, spans string, doc string")
    for rows in (pii_crf.find(clash, pii_crf.fit(clash)), secret_scan.scan(clash)):
        assert rows.select("doc.*").columns == clash.columns and rows.count() == 1
    assert pii_crf.digest(clash.limit(0)).count() == 0
    assert got[100].n_phone == 1 and got[100].n_added == 1 and got[101].spans == "" and got[5].n_added == 0


def test_pages(spark):
    html = '<html><body><nav>m</nav><div class="ad">x</div><article><h1>T{0} &amp; u</h1><p><b>one<br>two\n three{0}<p>four<ul><li>5<li>6</ul><section class="comments"><article>no</article></section></article><footer>f'
    rows = [(i, "http://h.example/" + str(i), html.format(i)) for i in range(6)]
    plain = "<body><div>Same title</div><p>text {0}</p><script>var t='</p>'</script></body>"
    rows += [(10 + i, f"http://plain.example/{i}", plain.format(i)) for i in range(5)] + [(20, None, None), (21, "x", "")]
    got = {r.page_id: r.text for r in wrappers.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 & u\n\none two three3\n\nfour\n\n5\n\n6"
    assert got[12] == "text 2" and got[20] == "" and got[21] == ""
    folded = wrappers.fold(wrappers.stream(wrappers.parts("<ul><li>a</li><li>b</li><li>c</li></ul>")))
    assert folded == ["ul", "+(li # /li)", "/ul"]


def test_names_of_classes():
    """Names count as a whole; those that say what an element is not or has do not; the article's surroundings stay."""
    cases = {
        '<article class="post no-comments"><p>body</p></article>': "body",
        '<div class="content with-sidebar"><p>body</p></div>': "body",
        '<main><div class="post-share-enabled"><p>body</p></div></main>': "body",
        '<article><div class="entry-header"><h1>Head</h1></div><p>body</p></article>': "Head\n\nbody",
        '<article><section class="header"><h1>Head</h1></section><p>body</p></article>': "Head\n\nbody",
        '<article class="teaser"><p>short</p></article><div><p>the long story</p></div>': "the long story",
        '<div class="widget"><article><p>body</p></article></div>': "body",
        '<article><p>body</p><div class="comments-area"><p>much longer than the body is</p></div><div class=share-buttons>s</div></article>': "body",
    }
    assert {h: wrappers.extract(h) for h in cases} == cases


def test_wrappers_change_what_is_read(spark):
    """Template text in and beside the article and menus of links go; copies of one page and optional parts stay."""
    inside = "<body><article><h1>{0}</h1><p>Follow our channel</p><p>{1}</p></article></body>"
    menu = "<body><div><p><a href=x>Home {0}</a></p><p><a href=y>News {0}</a></p><p><a href=y>More {0}</a></p></div><div>Site</div><div><p>{1}</p><p>{1} again</p></div></body>"
    rows, want = [], {}
    for i in range(6):
        long = f"the story of page {i} " * 8
        rows += [(i, f"https://in.example/{i}", inside.format(f"Title {i}", long)), (10 + i, f"https://menu.example/{i}", menu.format(i, long)), (20 + i, f"https://copy.example/{i}", inside.format("Same", "text") + "<!-- %d -->" % i)]
        own = " ".join(long.split())
        want |= {i: f"Title {i}\n\n{own}", 10 + i: f"{own}\n\n{own} again", 20 + i: "Same\n\nFollow our channel\n\ntext"}
    rows += [(40, None, inside.format("a", "b")), (41, "/no/host", inside.format("a", "c"))]
    want |= {40: "a\n\nFollow our channel\n\nb", 41: "a\n\nFollow our channel\n\nc"}
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, wrapper string, weight string")
    assert {r.page_id: r.text for r in wrappers.digest(table).collect()} == want
    without = {r[0]: wrappers.extract(r[2]) for r in rows}
    assert [i for i in want if want[i] != without[i]] == [i for i in want if i < 20]
    assert wrappers.digest(table.limit(0)).count() == 0


def test_alignment_takes_linear_time():
    import time

    rng = random.Random(6)
    a = [rng.choice(["p", "#", "/p", f"x{rng.randrange(9_000)}"]) for _ in range(60_000)]
    b = [x if rng.random() < 0.8 else rng.choice(["p", "#", "y"]) for x in a]
    began = time.time()
    pairs = wrappers.matches(a, b)
    assert time.time() - began < 10 and len(pairs) > 40_000
    assert all(a[i] == b[k] for i, k in pairs) and all(i < j and k < m for (i, k), (j, m) in zip(pairs, pairs[1:]))
    same = [str(i % 7) for i in range(30_000)]
    assert all(x == y for x, y in ((same[i], same[::-1][k]) for i, k in wrappers.matches(same, same[::-1])))


def test_wrappers_of_all_pages_by_place(spark, monkeypatch):
    """A text counts as a template's only if all pages of the host have it, and only in its place."""
    page = "<body><div>Head</div><h2>{0}</h2><p>{1}</p></body>"
    rows = [(i, f"http://h.example/{i}", page.format("Same" if i < 29 else "Other", "Head" if i == 7 else f"text {i}")) for i in range(30)]
    rows += [(40, "http://h.example/40", ""), (41, "http://h.example/0", rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.digest(table).collect()}
    assert got == {**{i: f"{'Same' if i < 29 else 'Other'}\n\n{'Head' if i == 7 else f'text {i}'}" for i in range(30)}, 40: "", 41: "Same\n\ntext 0"}
    monkeypatch.setattr(wrappers, "FAN", 3)
    whole, blocks = (wrappers.wrappers(table, block_pages=n).first() for n in (1_000, 4))
    assert whole == blocks and (whole.pages, whole.weight) == (30, 32)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= ids and all(r.n_tokens == len(r.token_ids) for r in rows)


def test_near_copies(spark, docs):
    """Against all pairs of small texts, whose similarity is exact."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        one = rng.choices(words, k=rng.choice([8, 60, 200]))
        texts.append(one)
        for changes in (1, 1, 2, 5, 12):
            other = list(one)
            for _ in range(changes):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(other)
    texts += [[], [], ["one"], ["one"]]
    sets = [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = list(range(len(texts)))
    for _ in range(8):
        want = [min(want[j] for j in range(len(texts)) if near(sets[i], sets[j])) for i in range(len(texts))]
    table = spark.createDataFrame([(i, " ".join(t).upper(), "kept") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(table).collect()}
    assert got == dict(enumerate(want))
    split = {r.doc_id: r.component_id for r in simhash.similar_groups(table, split_rows=1).collect()}
    assert split == got
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(want)
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.deduplicate(docs).filter("doc_id IS NULL").count() == 1


def test_repeated_lines_do_not_hide_near_copies(spark):
    """A text and its copy with a line many times over have nearly the same set of shingles."""
    rng = random.Random(11)
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(240)) for _ in range(12)]
    texts += [t + " now one line that comes often" * 50 for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.similar_groups(table).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 12 for i in range(24)}
    own = [np.arange(10, dtype="<u4"), np.arange(9, dtype="<u4"), np.arange(50, 60, dtype="<u4")]
    assert simhash.similar_forest([1, 2, 3], [0, (1 << 64) - 1, 0], own) == [(1, 2)]


def test_sizes_of_alike_sets_share_a_band(spark):
    """Size bands may only separate sets whose similarity is below 0.8: a size and the largest one it can be alike with."""
    rows = [(2 * i + side, i, n if side == 0 else n * 5 // 4, 1_000) for i, n in enumerate([1, 2, 4, 5, 16, 40, 99, 1_000, 12_345]) for side in (0, 1)]
    placed = spark.createDataFrame(rows, "key long, pair long, size long, count long")
    bands: dict[int, set] = {}
    for r in simhash.size_bands(placed).collect():
        bands.setdefault(r.key, set()).add(r.band)
    assert all(len(b) == 2 for b in bands.values())
    assert all(bands[2 * i] & bands[2 * i + 1] for i in range(len(rows) // 2))
    assert {r.band for r in simhash.size_bands(placed, split_rows=5_000).collect()} == {-1}


def test_sketches_of_long_texts_estimate_their_similarity():
    rng = np.random.default_rng(1)
    for share, want in ((0.95, True), (0.5, False)):
        pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, 40_000, np.uint64)))
        n = int(len(pool) * 2 * share / (1 + share) / 2)
        a, b = pool[: len(pool) // 2], np.concatenate([pool[:n], pool[len(pool) - (len(pool) // 2 - n) :]])
        cut = lambda h: (np.unique(h)[: simhash.SKETCH] >> np.uint64(32)).astype("<u4")
        assert simhash.alike(cut(a), cut(b)) == want
