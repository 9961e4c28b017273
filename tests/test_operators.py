"""Redaction, personal data, spans, times, model answers: small cases with known results."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions.text import clean_lines
from tracewright.functions.times import duration_label, instant, wall
from tracewright.operators import episodes as E
from tracewright.operators import model, redaction
from tracewright.operators.messages import sampled
from tracewright.operators.summary import capture_window
from tracewright.plans.analysis import progress

MESSAGES = "trace_id string, msg_index long, role string, text string, timestamp string, source string"


def trace(spark, texts, roles=None):
    roles = roles or ["assistant"] * len(texts)
    return spark.createDataFrame([("t", k, r, x, f"2026-06-07T00:0{k}:00Z", "s") for k, (x, r) in enumerate(zip(texts, roles, strict=True))], MESSAGES)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def redacted(spark, text):
    row = redaction.redact(spark.createDataFrame([(text,)], "text string")).first()
    return row["text"], row["redactions"], row["redaction_count"]


def test_redaction(spark):
    secrets = "Authorization: Bearer " + "a" * 16 + " jo@ex.com gh" + "p_" + "b" * 24 + " /Users/al/x.py https://e.com/c?code=1"
    text, found, n = redacted(spark, secrets)
    assert n == 5 and found["email address"] == 1 and "[REDACTED_BEARER_TOKEN]" in text and "https://e.com/c?[REDACTED_QUERY]" in text
    assert redacted(spark, "D:\\Users\\al\\x end")[0] == "C:\\Users\\[REDACTED_USER]\\[REDACTED_PATH] end"
    assert redacted(spark, "A" * 50 + "== end")[0] == "[REDACTED_LONG_TOKEN]== end"
    assert redacted(spark, "") == ("", {}, 0) and redacted(spark, None) == (None, {}, 0)


@pytest.mark.parametrize(
    "text, spans, expected, n",
    [
        ("Call Alice Smith at 555-1234 tomorrow.", [(5, 16, "private_person"), (20, 28, "private_phone")], "Call [REDACTED_NAME] at [REDACTED_PHONE] tomorrow.", 2),
        ("abc", [(0, 999, "private_person"), (2, 2, "secret")], "abc", 0),
        ("abc", [(0, 3, "not_a_pii_type")], "abc", 0),
        ("Alice Smith calls", [(0, 5, "private_person"), (5, 11, "private_person")], "[REDACTED_NAME] calls", 1),
        ("Alice Smith", [(0, 5, "private_person"), (6, 11, "private_person")], "[REDACTED_NAME]", 1),
        ("Alice 555-1234", [(0, 5, "private_person"), (6, 14, "private_phone")], "[REDACTED_NAME] [REDACTED_PHONE]", 2),
        ("😀 Bob", [(2, 5, "private_person")], "😀 [REDACTED_NAME]", 1),
    ],
)
def test_personal_data(spark, text, spans, expected, n):
    df = spark.createDataFrame([(text, spans)], f"text string, spans {redaction.SPANS}")
    row = redaction.redact_personal(df, F.col("spans")).first()
    assert (row["text"], row["pii_count"]) == (expected, n)


def test_detectors_are_injected_and_may_fail(spark):
    df = spark.createDataFrame([("Bob",), (" ",), (None,)], "text string").coalesce(1)
    found = redaction.detect(df, lambda texts: [[{"start": 0, "end": 3, "label": "private_person", "score": 0.9}, {"start": 0, "end": 1, "label": "secret", "score": 0.1}] for _ in texts])
    assert [len(r["spans"]) for r in found.collect()] == [1, 0, 0]

    def broken(texts):
        raise RuntimeError("no weights")

    rows = redaction.detect(df, broken).collect()
    assert {r["detector_error"] for r in rows} == {"RuntimeError"} and rows[0]["spans"] is None


def test_codebook_behaviour(spark):
    rows = lambda *texts: E.episodes(trace(spark, texts)).collect()
    e = rows("I will fix the auth test.", "The auth test still fails with a timeout error.", "The workaround is to skip it.", "Done, it should work now.")[0]
    assert (e["detour_type"], e["outcome_claim"], e["recovery_pattern"]) == ("premature_closure", "premature_success_claim", "overconfident_recovery")
    e = rows("I will read on.", "The requirement is ambiguous, but I go on.", "I will narrow scope.", "Ok.")[0]
    assert e["difficulty_type"] == "requirement_uncertainty" and "narrow scope" in e["strategy_after"]
    assert rows("A circular civic decision, but a problem.")[0]["difficulty_type"] != "environment_blocker"
    assert rows("All is well.", "Fine.") == []
    many = E.episodes(trace(spark, ["There is a problem, but wait."])).first()
    assert many["title"] == "Unknown: There is a problem, but wait."


def test_windows_count_user_messages_but_start_at_none(spark):
    m = trace(spark, ["I will look.", "I will ask.", "u", "an error, but", "u", "done", "x"], ["assistant", "user", "user", "assistant", "user", "assistant", "assistant"])
    assert E.candidate_spans(m).select("msg_index", "start_index", "end_index").collect() == [(3, 3, 5)]


def test_merging_touches_and_caps(spark):
    rows = [("t", k, a, b) for k, (a, b) in enumerate([(0, 2), (3, 4), (6, 7), (6, 12), (8, 9)])] + [("u", k, 10 * k, 10 * k) for k in range(20)]
    spans = spark.createDataFrame(rows, "trace_id string, msg_index long, start_index long, end_index long")
    merged = E.merged_spans(spans)
    assert sorted((r["start_index"], r["end_index"]) for r in merged.where("trace_id = 't'").collect()) == [(0, 4), (6, 12)]
    assert merged.where("trace_id = 'u'").count() == 12


@pytest.mark.parametrize(
    "a, b, label",
    [
        ("2026-06-06T10:00:00Z", "2026-06-06T10:03:12Z", "3m 12s"), ("20260606T100000Z", "2026-06-06T12:00:00,5+01:00", "1h 0m"), ("2026-06-06", "2026-06-06 00:00:59", "59s"),
        ("2026", "2026-06-06", "unknown"), ("10:00:00", "11:00:00", "unknown"), (None, "2026-06-06", "unknown"), ("2026-06-07", "2026-06-06", "unknown"), ("2026-06-06T10Z", "2026-06-08T10:00", "48h 0m"),
    ],
)
def test_durations(spark, a, b, label):
    assert one(spark, duration_label(F.lit(a), F.lit(b))) == label


def test_week_dates_are_read_as_python_reads_them(spark):
    from datetime import datetime

    texts = [f"{y}-W{w:02d}-{d}" for y in (2020, 2021, 2024, 2026) for w in (0, 1, 9, 52, 53, 54) for d in (0, 1, 7, 8)]
    texts += ["2026-W05", "2026W051", "2026W05", "2026-W051", "2026W05-1", "2026-W05-1T10:20:30", "2026W051T102030Z", "2026-W5-1"]

    def python(text):
        try:
            return f"{datetime.fromisoformat(text):%Y-%m-%d %H:%M:%S}"
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", wall(F.col("t"))).collect()} == {t: python(t) for t in texts}


def test_clock_keeps_the_texts_own_offset(spark):
    assert one(spark, wall(F.lit("2026-06-06T23:30:00-05:00"))) == "2026-06-06 23:30:00"
    assert one(spark, instant(F.lit("2026-06-06T23:30:00-0500"))).isoformat() == "2026-06-07T04:30:00"
    assert one(spark, wall(F.lit("noon"))) is None and one(spark, wall(F.lit("2026-06-06"))) == "2026-06-06 00:00:00"
    assert one(spark, clean_lines(F.lit("\r\n \n a \r b\u00a0\n\n"))) == " a\n b"


def test_capture_shapes(spark):
    shape = lambda a, b: capture_window(spark.createDataFrame([("t", 1, a, b, "unknown")], "trace_id string, episode_no long, start_time string, end_time string, duration_label string")).first()
    assert shape("2026-06-06T10:00:00Z", "2026-06-07T11:30:00Z")["captured"] == "2026-06-06 10:00 → 2026-06-07 11:30 UTC"
    assert shape("2026-06-06T10:00:00Z", "later") [1:] == ("2026-06-06 · 10:00 UTC", "unknown")
    assert shape("some day", None)["captured"] == "some day" and shape(None, None)["captured"] == "—"


def test_sampling_keeps_the_ends(spark):
    m = spark.createDataFrame([("t", k, "user", "w " * 300, None, "s") for k in range(120)], MESSAGES)
    lines = sampled(m).orderBy("msg_index").collect()
    assert len(lines) == 51 and lines[0]["msg_index"] == 0 and lines[-1]["msg_index"] == 119
    assert lines[1]["line"].startswith("[2] user : w w") and len(lines[1]["line"]) <= 320 + len("[2] user : ")


def test_model_answers(spark):
    read = model.read_answer
    assert read('```json\n{"episodes": []}\n```') == {"episodes": []}
    assert read('first {"a": {"b": 1}} then {"episodes": [1]} end') == {"episodes": [1]}
    for bad in ("", "no json", "[1]", '{"episodes": 1}', "{broken"):
        with pytest.raises(ValueError):
            read(bad)
    m = trace(spark, ["a problem, but", "b"])
    sound = '{"episodes": [{"start_index": 1, "end_index": -4, "title": "short verbatim x", "reported_difficulty": "D", "recovery_pattern": "bogus", "evidence_quotes": "ab"}]}'
    answers = spark.createDataFrame([("t", sound)], "trace_id string, content string")
    e = model.take_over(E.episodes(m), model.parsed(answers), m).collect()
    assert [(x["start_index"], x["end_index"], x["title"], x["recovery_pattern"], x["evidence_quotes"], x["duration_label"]) for x in e] == [(0, 1, "D", "unknown", ["a", "b"], "1m 0s")]
    failed = model.generate(spark.createDataFrame([("t", "p")], "trace_id string, prompt string"), lambda prompt: 1 / 0)
    kept = model.take_over(E.episodes(m), model.parsed(failed), m).collect()
    assert kept == E.episodes(m).collect()
    assert "E01 msgs 0-1" in model.prompts(sampled(m), E.episodes(m)).first()["prompt"]


def test_progress_is_monotone(spark):
    m = spark.createDataFrame([("t", k, "user", "w", None, "s") for k in range(95)], MESSAGES)
    pct = [r["pct"] for r in progress(m).orderBy("key").collect()]
    assert pct[0] == 12 and pct[-3:] == [55, 62, 70] and pct == sorted(pct) and 40 in pct


def test_streaming_ingest_equals_batch(spark, tmp_path):
    from tracewright.streaming import ingest

    m = trace(spark, ["I will look.", "The test fails with an error, but I go on.", "Done."])
    m.coalesce(1).write.json(str(tmp_path / "in"))
    folder = lambda name: str(tmp_path / name)
    query = ingest.ingest(ingest.arriving(spark, folder("in")), folder("store"), folder("out"), folder("state"))
    query.awaitTermination(120)
    assert ingest.latest(spark, folder("out")).drop("batch").collect() == E.episodes(m).select(*E.COLUMNS).collect()
