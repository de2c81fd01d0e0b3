"""Batches taken in small slices."""

import pyarrow as pa

from docaudit.functions import slices
from docaudit.operators import segment


def test_a_slice_holds_few_rows_and_bytes():
    texts = ["x" * 700_000] * 7 + [None, ""] * 700 + ["y" * 5_000_000, "z"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    parts = list(slices.slices(batch, "text"))
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(len(texts)))
    assert all(len(p) <= slices.ROWS and (len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= slices.BYTES) for p in parts)


def test_rows_of_each_text(spark):
    df = spark.createDataFrame([(i, "A b. " * i if i % 3 else None) for i in range(1200)], "doc_id long, text string").coalesce(1)
    got = slices.each_text(df, "doc_id", "text", "n int, t string", lambda: lambda t: [(k, t[k]) for k in range(min(2, len(t)))])
    want = sum(2 for i in range(1200) if i % 3)
    assert got.count() == want and got.where("n = 1 AND t <> ' '").count() == 0
    assert segment.detect_sections(df).count() == 1200
