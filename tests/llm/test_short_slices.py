"""Near-dedup of slices that hold fewer words than a shingle."""

import pytest

from tracewright.llm import near_dedup


@pytest.mark.parametrize("n", range(7))
def test_a_lone_short_text(spark, n):
    text = " ".join(f"w{k}" for k in range(n))
    sets = near_dedup.shingle_sets([text.encode()])
    together = near_dedup.shingle_sets([text.encode(), b"a b c d e f g h"])
    assert sets[0].tolist() == together[0].tolist() and len(sets[0]) == (n > 0) + (n > 5)
    if n in (2, 3):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [tuple(r)[:4] for r in near_dedup.near_dedup(docs).collect()] == [(1, 1, 1, True)]
