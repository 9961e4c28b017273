"""The whole analysis with detector, model and engines, as a user of it calls it."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.operators import episodes as E
from tracewright.operators import redaction
from tracewright.operators import summary as S
from tracewright.operators.report import model_status
from tracewright.plans.analysis import analyze, analyze_files
from tracewright.plans.fixtures import narrated
from tracewright.plans.queries import QUERIES
from tracewright.sources import scratch, traces

SF = "/root/testdata/sf0.001"
NBSP, IDEOGRAPHIC = " ", "　"
HARD = "The auth test still fails with a timeout, a risk and an error."
ANSWER = {
    "verdict": {"tone": "partial", "headline": "Half way.", "detail": "Told.", "honesty": "candid"}, "overall_patterns": {"difficulty_style": "Mostly auth."},
    "episodes": [{"start_index": 0, "end_index": 1, "title": "Auth", "reported_difficulty": "It fails.", "difficulty_type": "localization_difficulty", "outcome_claim": "not_resolved"}],
}


def messages(spark, *said):
    """said: (trace, text)."""
    rows, n = [], {}
    for t, text in said:
        n[t] = n.get(t, -1) + 1
        rows.append((t, n[t], "assistant", text, f"2026-01-02T03:04:{n[t]:02d}Z", "test"))
    return spark.createDataFrame(rows, "trace_id string, msg_index long, role string, text string, timestamp string, source string")


def told(out, trace="a"):
    """The view and the report of a trace."""
    view = json.loads(out["views"].where(F.col("trace_id") == trace).first()["view"])
    return view, out["reports"].where(F.col("trace_id") == trace).first()["report"]


def test_a_detector_is_joined_to_patterns(spark):
    m = messages(spark, ("a", "Ann Lee wrote to x@example.org. " + HARD), ("b", "nothing"), ("c", "Ann Lee fails here"))

    def detector(texts):
        if any("fails here" in t for t in texts):
            raise RuntimeError("no device")
        return [[{"start": 0, "end": 7, "label": "private_person"}] if t.startswith("Ann") else [] for t in texts]

    out = analyze(m.coalesce(1), detector=detector)
    texts = {r["trace_id"]: r["text"] for r in out["messages"].collect()}
    assert texts["a"].startswith("[REDACTED_NAME] wrote to [REDACTED_EMAIL].") and texts["c"] == "Ann Lee fails here"
    notes = {r["trace_id"]: (r["redaction_count"], r["privacy_notes"][3:]) for r in out["traces"].collect()}
    screened, none = V.PRIVACY_NOTES["screened"], V.PRIVACY_NOTES["none"]
    assert notes["a"] == (2, [screened, "Redactions applied: email address (1), personal name (1)."])
    assert notes["b"] == (0, [screened, none])
    assert notes["c"] == (0, [V.PRIVACY_NOTES["unavailable"] % "RuntimeError", none])  # a trace that fails leaves the others alone
    assert "personal name (1)" in told(out)[1] and "Redaction count: 2" in told(out)[1]


def test_labels_of_both_passes_add_up(spark):
    m = messages(spark, ("a", "x@example.org and y at example"))
    out = redaction.two_passes(m, lambda texts: [[{"start": len(t) - 12, "end": len(t), "label": "private_email"}] for t in texts]).first()
    assert out["redactions"] == {"email address": 2} and out["redaction_count"] == 2


def test_redaction_and_tool_notes_can_be_off(spark):
    out = analyze(messages(spark, ("a", "mail x@example.org")), redact_secrets=False, without_tools=False)
    assert out["messages"].first()["text"] == "mail x@example.org"
    assert out["traces"].first()["privacy_notes"][2:] == [V.PRIVACY_NOTES["disabled"]]


def test_a_models_words_go_before_the_rules(spark):
    m = messages(spark, ("a", HARD), ("a", "I will retry."))
    view, report = told(analyze(m, model=lambda prompt: json.dumps(ANSWER), engine="nemotron"))
    name = V.MODELS["nemotron"]
    assert view["engine"] == name and view["verdict"] == {"tone": "partial", "headline": "Half way.", "detail": "Told.", "honesty": "candid"}
    assert [e["difficulty_type"] for e in view["episodes"]] == ["localization_difficulty"] and view["overall_patterns"] == {"difficulty_style": "Mostly auth."}
    assert f"- Analysis produced by {name}." in report and "Mostly auth." in report and V.REPORT["no_caveat"] in report and V.REPORT["no_recovery"] in report
    assert view["model_status"] == f"{V.MODEL_STATUS[False]} Analysis produced by {name}." and view["privacy_notes"][-1] == f"Analysis produced by {name}."


def test_a_model_without_episodes(spark):
    view, report = told(analyze(messages(spark, ("a", HARD)), model=lambda prompt: '{"episodes": []}', engine="minicpm"))
    assert view["episodes"] == [] and view["verdict"]["headline"] == V.NO_EPISODE[1] and view["captured"] == "—" and view["duration_total"] == "—"
    assert V.REPORT["no_timeline"] in report and view["overall_patterns"] == V.NO_PATTERNS


def test_a_failing_model_leaves_the_rules(spark):
    m = messages(spark, ("a", HARD))
    rules, _ = told(analyze(m))

    def broken(prompt):
        raise ValueError("model unavailable.")

    view, report = told(analyze(m, model=broken, engine="minicpm"))
    note = "Model analysis was requested but unavailable: ValueError: model unavailable. Rule-based analysis was returned."
    assert f"- {note}" in report and view["engine"] == V.RULE_ENGINE and view["model_status"].startswith(V.MODEL_STATUS[True])
    assert view["episodes"] == rules["episodes"] and view["verdict"] == rules["verdict"] and rules["model_status"] == ""


def test_unknown_engines_and_missing_models(spark):
    m = messages(spark, ("a", HARD))
    view, report = told(analyze(m, engine="missing-engine"))
    assert "Unknown analysis engine 'missing-engine'; rule-based analysis was returned." in report and view["model_status"].startswith(V.MODEL_STATUS[True])
    with pytest.raises(ValueError, match="needs a model"):
        analyze(m, engine="minicpm")


def test_notes_about_the_model(spark):
    rows = [["Analysis produced by m."], ["x", "Model assist was off: deterministic analysis was returned."], ["The analysis uses visible messages"], []]
    df = spark.createDataFrame([(r,) for r in rows], "n array<string>")
    assert [r[0] for r in df.select(model_status(F.col("n"))).collect()] == [f"{V.MODEL_STATUS[False]} {rows[0][0]}", f"{V.MODEL_STATUS[True]} {rows[1][1]}", "", ""]


def test_files_names_and_errors(spark, tmp_path):
    for name, text in (("one.jsonl", '{"role": "assistant", "content": "%s"}' % HARD), ("two.txt", "User: hi\nAgent: there"), ("three.json", "{"), ("four.json", " ")):
        (tmp_path / name).write_text(text)
    url = lambda name: f"file:{tmp_path}/{name}"
    originals = spark.createDataFrame([(url("one.jsonl"), "mine.jsonl")], "trace_id string, original string")
    out = analyze_files(spark, str(tmp_path), originals=originals)
    titles = {r["trace_id"].rsplit("/", 1)[1]: r["trace_title"] for r in out["traces"].collect()}
    assert titles == {"one.jsonl": "Agent · mine.jsonl", "two.txt": "Agent trace: two"}
    errors = {r["trace_id"].rsplit("/", 1)[1]: r["error"] for r in out["errors"].collect()}
    assert errors["four.json"] == "The uploaded trace is empty." and errors["three.json"].startswith("The JSON trace could not be parsed")
    whole = {r["trace_id"]: json.loads(r["json"]) for r in out["episodes_json"].collect()}
    assert whole[url("one.jsonl")]["episodes"][0]["message_span"]["start_index"] == 0 and whole[url("two.txt")]["episodes"] == []


@pytest.mark.parametrize("space", [NBSP, IDEOGRAPHIC, "\x1f", " ", "\x0b"])
def test_any_white_space_parts_words(spark, space):
    low = spark.createDataFrame([(f"it could{space}not be done",)], "text string")
    flags = E.flagged(low.withColumn("role", F.lit("assistant"))).first()
    assert flags["difficulty_score"] == 1 and flags["has_outcome"]
    paths = spark.createDataFrame([(f"see /home/al/x{space}y/z and Authorization:{space}Bearer{space}abcdefghijkl {space}https://a.b/c?d=e{space}f",)], "text string")
    text = redaction.redact(paths).first()["text"]
    assert text == f"see /home/[REDACTED_USER]/[REDACTED_PATH]{space}y/z and Authorization:{space}Bearer{space}[REDACTED_BEARER_TOKEN] {space}https://a.b/c?[REDACTED_QUERY]{space}f"


def test_redaction_takes_what_is_no_text(spark):
    rows = redaction.redact(spark.createDataFrame([(None,), ("",), ("A" * 60,)], "text string")).collect()
    assert [(r["text"], r["redaction_count"], r["redactions"]) for r in rows] == [(None, 0, {}), ("", 0, {}), ("[REDACTED_LONG_TOKEN]", 1, {"long base64-like secret": 1})]


def test_each_clue_stands_where_its_rule_matches():
    assert len(V.REDACTION_CLUES) == len(V.REDACTIONS) and all(c == c.lower() for clues in V.REDACTION_CLUES for c in clues)


def test_agents_are_told_by_keys_of_the_record_itself(spark):
    shapes = {
        '{"type": "x", "payload": {"a": 1, "parentUuid": null}}': None, '{"sessionId": null}': "claude_code", '{"a": {"userType": "x"}, "b": "\\"userType\\": null"}': None,
        '{"x": NaN, "userType": "external"}': "claude_code", '["parentUuid"]': None,
    }
    df = spark.createDataFrame([(s,) for s in shapes], "record string")
    assert [r[0] for r in df.select(traces.record_agent(F.col("record"))).collect()] == list(shapes.values())


def test_episodes_need_one_exchange(spark):
    plan = QUERIES["episodes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_spans_told_by_windows_are_those_of_the_join(spark):
    m = narrated(spark, "/root/testdata/sf0.01")
    spans = E.merged_spans(E.candidate_spans(m)).withColumnRenamed("trace_id", "t")
    joined = m.where("role = 'assistant'").join(spans, (F.col("trace_id") == F.col("t")) & F.col("msg_index").between(F.col("start_index"), F.col("end_index"))).select("trace_id", "episode_no", "msg_index")
    own = E.span_messages(m).select("trace_id", "episode_no", "msg_index")
    assert own.exceptAll(joined).count() == 0 and joined.exceptAll(own).count() == 0 and own.count() > 0


def test_a_scratch_folder_of_one_machine_is_refused_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="share"):
        scratch.shared_folder(Session())


def test_scratch_tables_can_be_dropped(spark):
    from pathlib import Path

    kept = scratch.stored(spark.range(3), "some")
    folder = Path(scratch.shared_folder(spark).removeprefix("file:")) / "tracewright"
    assert kept.count() == 3 and any(folder.iterdir())
    scratch.drop_scratch(spark)
    assert not folder.exists()


def test_a_message_that_comes_again_counts_as_the_newest_batch_has_it(spark, tmp_path):
    from tracewright.streaming import ingest

    folder = lambda name: str(tmp_path / name)
    for k, text in enumerate(("nothing new", HARD)):
        messages(spark, ("a", text), ("b", HARD)).write.mode("append").json(folder("in"))
        ingest.ingest(ingest.arriving(spark, folder("in")), folder("store"), folder("out"), folder("state")).awaitTermination()
        newest = {r["trace_id"] for r in ingest.latest(spark, folder("out")).collect()}
        assert newest == ({"b"}, {"a", "b"})[k]


def test_summaries_of_one_row_are_those_of_many(spark):
    e = QUERIES["episodes"](spark, "/root/testdata/sf0.01")
    assert S.by_trace(e).select(F.sum(F.size("e"))).first()[0] == e.count()
