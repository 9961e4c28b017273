"""A text without any clue to a secret goes past the rules."""

from pyspark.sql import functions as F

from tracewright.operators import redaction


def test_texts_without_clues_meet_no_rule(spark, monkeypatch):
    rows = [("nothing here",), (None,), ("",), ("Q" * 52,), ("mail A@B.com",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    got = [(r["text"], r["redactions"], r["redaction_count"]) for r in redaction.redact(df).collect()]
    assert got == [("nothing here", {}, 0), (None, {}, 0), ("", {}, 0), ("[REDACTED_LONG_TOKEN]", {"long base64-like secret": 1}, 1), ("mail [REDACTED_EMAIL]", {"email address": 1}, 1)]
    # rules that fail where they are tried
    monkeypatch.setattr(redaction, "_all_rules", lambda text, low: F.struct(F.raise_error(F.lit("tried")).cast("string").alias("text"), F.array().cast("array<bigint>").alias("counts")))
    assert [r["redaction_count"] for r in redaction.redact(df.where("text = 'nothing here' OR text = ''")).collect()] == [0, 0]
