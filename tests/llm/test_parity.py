"""The parity flag of a codec that has encoded before."""

from cloudspark.llm import sp_codec


def test_a_warm_codec_still_compares():
    codec = sp_codec.Codec(sp_codec.read_model())
    texts = ["one two three", "two words", ""]
    assert all(same for _, same in codec.encode(texts))
    asked = []
    library = codec.reference_ids

    def other(segments):
        asked.extend(segments)
        return [x + [7] if x else x for x in library(segments)]

    codec.reference_ids = other
    assert [same for _, same in codec.encode(texts, verify=True)] == [False, False, True]
    assert asked
    # what has been compared is not compared again, and its verdict stays
    asked.clear()
    assert [same for _, same in codec.encode(texts, verify=True)] == [False, False, True] and not asked


def test_whole_texts_are_compared_each_time():
    codec = sp_codec.Codec(sp_codec.read_model())
    texts = ["one two three", "two words", "", " a  b"]
    codec.encode(texts, verify=True)
    asked = []
    library = codec.reference_ids

    def other(whole):
        asked.extend(whole)
        return [[*x, 7] if i == 1 else x for i, x in enumerate(library(whole))]

    codec.reference_ids = other
    assert [same for _, same in codec.encode_whole(texts)] == [True, False, True, True] and asked == texts


def test_digest_and_pipeline_compare_whole_texts(spark):
    import corpus_pipeline

    class Other(sp_codec.Codec):
        def reference_ids(self, texts):
            return [[*x, 7] if len(t.split()) == 3 else x for t, x in zip(texts, super().reference_ids(texts), strict=True)]

    other = Other(sp_codec.read_model())
    assert [same for _, same in other.encode_whole(["a b c", "a b"])] == [False, True]
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x  y \u65e5")], "doc_id long, text string")
    rows = {r.doc_id: r for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    assert set(rows) == {1, 2, 3} and all(r.parity and r.n_tokens == len(r.token_ids) for r in rows.values())
    assert all(r.parity for r in sp_codec.digest(docs).collect())


def test_new_words_are_encoded_together():
    codec = sp_codec.Codec(sp_codec.read_model())
    library, asked = codec.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **settings):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **settings)

    codec.tokenizer = Counted()
    odd = ["", " ", "  a   b ", "日本 \U0001f642\n\nx", "▁", "a▁▁b ▁", "<s> </s>", "\x00 ́ é", " ".join("zq" * i for i in range(80))]
    texts = [" ".join(f"wo{i}rd{i * j}" for i in range(40)) for j in range(20)] + odd
    got = codec.encode(texts)
    assert len(asked) < len({x for t in texts[:20] for x in t.split()}) / 8
    assert [sp_codec.np.frombuffer(x, "<i4").tolist() for x, _ in got] == codec.reference_ids(texts)
    # a model in which marks begin no piece: one by one
    alone = sp_codec.Codec(sp_codec.read_model())
    alone.begins[:] = False
    assert alone.encode(texts, verify=True) == got


def test_what_comes_once_does_not_push_out_what_comes_again(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE_BYTES", 20_000)
    codec = sp_codec.Codec(sp_codec.read_model())
    once = [" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(40)]
    often = "some words that come again and again"
    codec.encode(once[:8])
    assert codec.older
    codec.encode([often])
    first = codec.encode([often])
    for text in once[8:]:
        codec.encode([text])
    assert all(x in codec.cache or x in codec.older for x in often.split())
    assert codec.encode([often]) == first and len(codec.cache) + len(codec.older) < 200
