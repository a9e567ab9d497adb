"""Columns of the input keep their names and values, whatever an operator calls its own."""

from cloudspark.llm import exact_dedup, simhash

NAMES = ("__row", "__copy", "of", "same", "copy", "doc", "kept", "text_sha256")


def test_deduplicate_keeps_columns(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "other words stand here now", None, ""]
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in NAMES)}")
    exact = exact_dedup.deduplicate(frame)
    assert exact.columns == frame.columns and {tuple(r) for r in exact.collect()} == {rows[1], rows[2], rows[4]}
    near = simhash.deduplicate(frame)
    assert near.columns == frame.columns and {tuple(r) for r in near.collect()} == {rows[0], rows[2], rows[3]}
