"""Whole results of the field, the hidden Markov model and the pipeline against brute force on small fixtures."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cloudspark.llm import hmm, kneser_ney, pii_crf, sp_codec
from test_operators import kneser_ney_model


def enumerate_labels(unary, edges, n):
    """Marginals by the sum over all labelings. edges: (i, j, log potential of i's label and j's)."""
    out = np.zeros((n, pii_crf.LABELS))
    for labels in itertools.product(range(pii_crf.LABELS), repeat=n):
        w = math.exp(sum(unary[i][k] for i, k in enumerate(labels)) + sum(m[labels[i], labels[j]] for i, j, m in edges))
        for i, k in enumerate(labels):
            out[i, k] += w
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("chain, skip, exact", [([(0, 1), (1, 2)], [(2, 4), (1, 3)], True), ([(0, 1), (1, 2), (3, 4)], [(0, 3)], True), ([(0, 1), (1, 2)], [(0, 2)], False)])
def test_messages_give_marginals(chain, skip, exact):
    """Exact on trees; close to it on a weak loop; known labels stay."""
    rng = np.random.default_rng(3)
    scale = 1.0 if exact else 0.2
    field = pii_crf.Field(rng.normal(size=(pii_crf.FEATURES, pii_crf.LABELS)), scale * rng.normal(size=(pii_crf.LABELS,) * 2), np.diag(scale * rng.random(pii_crf.LABELS)))
    nodes = rng.integers(0, pii_crf.FEATURES, (5, 3))
    fixed = np.array([-1, -1, -1, 2, -1])
    unary = field.weights[nodes].sum(1)
    unary -= np.logaddexp.reduce(unary, 1)[:, None]
    unary[3] = [-20, -20, 0, -20, -20]
    want = enumerate_labels(unary, [(i, j, field.chain) for i, j in chain] + [(i, j, field.skip) for i, j in skip], 5)
    got = pii_crf.beliefs(field, nodes, np.array(chain), np.array(skip), fixed)
    assert np.abs(got - want).max() < (1e-3 if exact else 0.02)


def test_labels_do_not_depend_on_the_batch():
    rng = random.Random(4)
    texts = [f"call {rng.choice(['+1 (743) 555-0', '743 555 0', '10.0.0.'])}{rng.randrange(200)} or 12-{rng.randrange(20)}" for _ in range(60)]
    seen, pairs = Counter(), {k: np.zeros((5, 5)) for k in "cs"}
    for t in texts:
        tokens = pii_crf.candidates(t)
        own = pii_crf.labels_of(tokens, pii_crf.base_spans(t))
        seen.update(((x.shape, x.before, x.after), k) for x, k in zip(tokens, own, strict=True))
        for name, edges in zip("cs", pii_crf.edges_of(tokens), strict=True):
            for i, j in edges:
                pairs[name][own[i], own[j]] += 1
    field = pii_crf.train(seen, pairs["c"], pairs["s"])
    whole = pii_crf.label(field, texts)
    assert whole == [pii_crf.label(field, [t])[0] for t in texts]
    long = " ".join(texts * 50)
    assert pii_crf.label(field, [long])[0][0] == pii_crf.base_spans(long)


def test_score_is_the_probability_of_the_words(spark):
    """Sum over paths with each word's own emission, for words with a symbol, without one and never seen."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5))) + rng.choice(["", " new" + str(i)])) for i in range(30)] + [(100, None), (101, "never seen")]
    import pyspark.sql.functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 4)
    head, hmm.HEAD = hmm.HEAD, 6
    try:
        fitted = hmm.fit(docs)
        got = {r.doc_id: r.score for r in hmm.score(fitted).collect()}
    finally:
        hmm.HEAD = head
    count = Counter(w for i, t in rows if i % 5 != 4 for w in hmm.tokens(t))
    ends = sum(i % 5 != 4 for i, _ in rows)
    top = [w for w, _ in sorted({**count, hmm.END: ends}.items(), key=lambda x: (-x[1], x[0]))[:7] if w != hmm.END][:6]
    model = fitted.model
    weight = np.ones(hmm.ENDINGS)
    for w, c in count.items():
        if w not in top:
            weight[hmm.ending(w)] += c + 1

    def emission(w):
        if w == hmm.END:
            return model.emit[0]
        if w in top:
            return model.emit[1 + top.index(w)]
        return model.emit[1 + len(top) + hmm.ending(w)] * (count[w] + 1) / weight[hmm.ending(w)]

    for i, t in rows:
        now = model.start.astype(float)
        for n, w in enumerate([*hmm.tokens(t), hmm.END]):
            now = (now if n == 0 else now @ model.move) * emission(w)
        assert abs(got[i] - math.log10(now.sum())) < 1e-3


def test_training_texts_longer_than_a_stretch_count(spark):
    import pyspark.sql.functions as F

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20_000))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    fitted = hmm.fit(docs)
    assert hmm.digest(docs.drop("held_out").limit(0)).count() == 0
    assert fitted.n == 60_003 and all(r.score / r.n_tokens > r.base_score / r.n_tokens - 0.05 for r in hmm.score(fitted).collect())


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages on a small corpus: what goes and what stays, and all texts and ids."""
    import sentencepiece
    import pyspark.sql.functions as F

    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("aeiou", k=1) + rng.choices("lmnrst", k=1)) * rng.randint(1, 2) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    foot = prose(9)
    texts = [prose(rng.randint(40, 90)) for _ in range(60)]
    texts = [f"{t}\n{foot}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[1] + " more", texts[2], texts[2], texts[4].replace("\n", " ", 1)]  # near and exact copies
    texts += ["%%% ### $$$ &&& " * 30, "@@@###!!!" * 20]  # poor
    items = [" ".join(texts[7].split()[5:20]), "nothing of this is anywhere in there", None]
    docs = [(i, t, "en", f"s{i % 10}", len(t)) for i, t in enumerate(texts)] + [(500, None, "en", "s1", 0), (501, "", None, None, 0)]
    labels = [(i, 1, 0) for i in range(50)] + [(64, 0, 0)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}

    # quality
    held = {r.i for r in spark.range(50).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(kneser_ney.HELD_OUT)) == 0).alias("h")).filter("h").collect()}
    trained = [texts[i] for i in range(50) if i not in held]
    p, _ = kneser_ney_model(trained)
    ln = lambda t: sum(math.log(p(tuple((["^"] * 3 + list(t))[i : i + 3]), x)) for i, x in enumerate([*t, "$"]))
    mean = -sum(map(ln, trained)) / sum(len(t) + 1 for t in trained)
    drawn = lambda t: (kneser_ney.PRIOR_CHARS * mean - ln(t)) / (len(t) + 1 + kneser_ney.PRIOR_CHARS)
    most = (np.percentile([math.floor(drawn(texts[i]) * kneser_ney.BINS) for i in held], 100 * kneser_ney.QUANTILE) + 1) / kneser_ney.BINS * kneser_ney.SLACK
    kept = {i: t for i, t, lang, _, _ in docs if not t or lang is None or drawn(t) <= most}
    assert set(range(60)) <= set(kept) and not {64, 65} & set(kept)
    # lines on eight sites and in eight groups of near copies
    lines = {i: None if t is None else "\n".join(x for x in t.split("\n") if x != foot) for i, t in kept.items()}
    # one of each group of texts that 0.8 of the shingles link
    sets = {i: shingles(t or "") for i, t in lines.items()}
    group = {i: i for i in lines}
    for _ in range(5):
        for i, j in itertools.permutations(lines, 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[i] = min(group[i], group[j])
    alone = {i: t for i, t in lines.items() if group[i] == i}
    assert len(alone) < len(lines) - 3
    # benchmark
    window = items[0].lower().split()
    clean = {i: t for i, t in alone.items() if not any((t or "").lower().split()[k : k + 10] == window[n : n + 10] for k in range(len((t or "").split())) for n in range(len(window) - 9))}
    assert 7 not in clean and len(clean) == len(alone) - 1
    other = sentencepiece.SentencePieceProcessor(model_proto=sp_codec.read_model())
    assert {i: (r.text, list(r.token_ids), r.n_chars) for i, r in got.items()} == {i: (t, other.encode(t or ""), None if t is None else len(t)) for i, t in clean.items()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    at = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []
