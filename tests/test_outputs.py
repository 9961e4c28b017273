"""Files for each trace, observed figures, devices, segments, and the prompt's agent."""

import json
import logging
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import devices
from tracewright.operators import episodes as E
from tracewright.operators import model as M
from tracewright.operators import summary as S
from tracewright.plans import analysis
from tracewright.plans.figures import Figures
from tracewright.sources import session_files
from tracewright.sources.logs import filesystem

SCHEMA = "trace_id string, msg_index long, role string, text string, timestamp string, source string"


@pytest.fixture(scope="module")
def messages(spark):
    said = ["The test failed with an error.", "Instead I will try another route for jo@example.com.", "Fixed it."]
    return spark.createDataFrame([(t, k, "assistant", x, f"2026-01-01T00:0{k}:00Z", "s") for t in ("a/b c.jsonl", ".hidden", "ü") for k, x in enumerate(said)], SCHEMA)


def files_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}


def test_files_of_each_trace_equal_the_relations(spark, messages, tmp_path):
    out = analysis.analyze(messages)
    for _ in range(2):  # a second time replaces them
        session_files.write_files(out, str(tmp_path))
    expected = {}
    for relation, column, name in (("narratives", "narrative", "narrative.md"), ("reports", "report", "field-report.md"), ("episodes_json", "json", "episodes.json")):
        expected |= {f"{session_files.folder_of(r.trace_id)}/{name}": r[column] for r in out[relation].collect()}
    assert files_of(tmp_path) == expected and len(expected) == 9
    assert all(json.loads(x)["engine"] for n, x in expected.items() if n.endswith(".json"))
    session_files.write_files({k: v.where("trace_id = 'ü'") for k, v in out.items()}, str(tmp_path), "overwrite")
    assert len(files_of(tmp_path)) == 3


def rows_of(n):
    return [{"trace_id": f"t{k}", "narrative": "n" * 5000, "report": "r", "episodes": None} for k in range(n)]


def test_a_task_that_fails_or_runs_twice_leaves_nothing(tmp_path):
    top = f"{tmp_path}/out"
    writer = session_files.FilesWriter(top, False)

    def failing():
        yield from rows_of(3)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    twice = [writer.write(iter(rows_of(4))), writer.write(iter(rows_of(4)))]
    assert not any(not n.startswith("_staging") for n in files_of(top))  # nothing shows before the commit
    writer.commit([twice[1], None])
    assert sorted(files_of(top)) == sorted(f"t{k}/{n}" for k in range(4) for n in ("narrative.md", "field-report.md"))
    assert not [n for n in os.listdir(top) if n.startswith("_")]
    lost = session_files.FilesWriter(top, True)
    message = lost.write(iter(rows_of(1)))
    lost.abort([message])
    assert len(files_of(top)) == 8 and not [n for n in os.listdir(top) if n.startswith("_")]
    assert filesystem(top)[2] == "file:"


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    spark.dataSource.register(session_files.SessionFiles)
    bad = spark.range(20).select(F.col("id").cast("string").alias("trace_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("bad row"))).otherwise("n").alias("narrative"), F.lit("r").alias("report"), F.lit("{}").alias("episodes"))
    with pytest.raises(Exception, match="bad row"):
        bad.repartition(4).write.format("session_files").mode("append").save(str(tmp_path))
    assert files_of(tmp_path) == {}


def test_observed_figures_equal_counts(spark, messages, caplog):
    seen = Figures()
    out = analysis.analyze(messages, figures=seen)
    got = {r.stage: r for r in seen.relation(spark).collect()}
    assert list(got) == ["extract", "redact", "chart", "classify"]
    assert got["extract"].rows == messages.count() == got["redact"].rows == out["messages"].count()
    assert got["extract"].bytes == sum(len(r.text.encode()) for r in messages.collect()) and got["redact"].bytes == sum(len(r.text.encode()) for r in out["messages"].collect())
    assert got["redact"].redactions == 3 and got["classify"].rows == out["episodes"].count() == got["chart"].rows > 0
    with caplog.at_level(logging.INFO):
        assert "redact 9 rows" in seen.summary() and "redact 9 rows" in caplog.text
    assert Figures().rows() == []


def test_a_stage_carries_its_profile(spark, messages, monkeypatch, caplog):
    wanted = devices.profile("cuda", cores=2, gpus=1)
    assert wanted.taskResources["gpu"].amount == 1.0 and wanted.taskResources["cpus"].amount == 2.0 and wanted.executorResources["gpu"].amount == 1
    assert devices.profile(None) is None and "gpu" not in devices.profile("cpu").taskResources
    asked = spark.createDataFrame([("t", "p")], "trace_id string, prompt string")
    with caplog.at_level(logging.WARNING):
        assert M.generate(asked, str.upper, wanted).first()["content"] == "P"  # without, on this machine
    assert "No resource profiles" in caplog.text
    given, real = [], type(asked).mapInPandas
    monkeypatch.setattr(type(asked), "mapInPandas", lambda self, run, schema, **options: given.append(options.get("profile")) or real(self, run, schema))
    monkeypatch.setattr(devices, "can_hold", lambda _: True)
    M.generate(asked, str.upper, wanted)
    analysis.analyze(messages, detector=lambda texts: [[] for _ in texts], model=str.upper, engine="minicpm", detector_profile=wanted, model_profile=wanted)
    assert given.count(wanted) == 3


def test_devices_in_the_order_of_choice(spark, monkeypatch):
    import sys
    import types

    torch = types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: False), backends=types.SimpleNamespace(mps=types.SimpleNamespace(is_available=lambda: True)))
    monkeypatch.setitem(sys.modules, "torch", torch)
    assert (devices.device("cpu"), devices.device(None)) == ("cpu", "mps")
    torch.cuda.is_available = lambda: True
    assert devices.device() == "cuda"
    monkeypatch.setitem(sys.modules, "torch", None)
    assert devices.device() == "cpu"


def test_segments_give_the_same_spans(spark):
    pick = random.Random(8)
    texts = ["The test failed with an error and a bug.", "I will look.", "Fixed and verified.", "Plain words.", "Plain words.", "Instead, the issue is a timeout."]
    rows = [(t, k, pick.choice(["assistant", "assistant", "user"]), pick.choice(texts[: 2 + t % 5]), None, "s") for t in range(12) for k in range(pick.choice([1, 7, 40, 130]))]
    some = spark.createDataFrame(rows, SCHEMA.replace("trace_id string", "trace_id long"))
    expected = sorted(tuple(r) for r in E.merged_spans(E.candidate_spans(some), 10**6).collect())
    for segment in (6, 13, 50, 1000):
        assert sorted(tuple(r) for r in E.segmented_spans(some, 10**6, segment).collect()) == expected, segment
    with pytest.raises(ValueError, match="segment"):
        E.segmented_spans(some, segment=3)
    assert len(expected) > 40


def test_segments_bound_a_task(spark):
    long = spark.range(20_000).select(F.lit(1).cast("long").alias("trace_id"), F.col("id").alias("msg_index"), F.lit("assistant").alias("role"), F.lit("The test failed with an error.").alias("text"), F.lit(None).cast("string").alias("timestamp"), F.lit("s").alias("source"))
    assert [tuple(r) for r in E.segmented_spans(long, segment=500).collect()] == [(1, 1, 0, 19_999)]


def test_the_prompt_names_the_agent(spark):
    lines = spark.createDataFrame([("t", 0, "[0] said"), ("u", 0, "[0] said")], "trace_id string, msg_index long, line string")
    none = spark.createDataFrame([], "trace_id string, episode_no long, episode_id string, start_index long, end_index long")
    agents = spark.createDataFrame([("t", "codex")], "trace_id string, agent string")
    prompts = {r.trace_id: r.prompt for r in M.prompts(lines, none, agents).collect()}
    assert "Agent type: codex\n" in prompts["t"] and "Agent type: unknown\n" in prompts["u"]
    assert "Agent type: unknown\n" in M.prompts(lines, none).first()["prompt"]


def test_the_first_selection_is_grave_in_a_grave_session(spark):
    e = lambda *patterns: [{"episode_id": f"E{k:02}", "recovery_pattern": p} for k, p in enumerate(patterns, 1)]
    rows = [({"tone": "risk"}, e("smooth_recovery", "failed_recovery")), ({"tone": "partial"}, e("smooth_recovery", "failed_recovery")), ({"tone": "risk"}, e("smooth_recovery")), ({"tone": "stable"}, [])]
    df = spark.createDataFrame(rows, "verdict struct<tone:string>, e array<struct<episode_id:string,recovery_pattern:string>>")
    assert [tuple(r) for r in df.select(*S.selection().values()).collect()] == [("E02", "E01"), ("E01", "E01"), ("E01", "E01"), ("", "")]
