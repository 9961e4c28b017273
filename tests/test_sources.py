"""The source of split logs, and records as VARIANT, against the reading of whole files by Python."""

import json
import random
import string

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.plans.analysis import analyze_files
from tracewright.sources import logs, records, traces


def test_ranges_give_each_line_once():
    pick = random.Random(1)
    for _ in range(300):
        ends = [b"\n", b"\r\n", b"\n", b"\r", b""]
        data = b"".join(pick.choice([b"", b"a", b"bb\xff", b"c\rc", "d e".encode(), b"x" * pick.randint(1, 9)]) + pick.choice(ends) for _ in range(pick.randint(0, 12)))
        expected = [x for x in data.decode("utf-8", "replace").splitlines() if x]
        for split in (1, 2, 3, 7, 50):
            got = [row for a in range(0, max(1, len(data)), split) for row in logs.LineReader(pa.BufferReader(data), a, min(a + split, len(data)), pick.choice([1, 2, 5, 100])).lines()]
            assert got == sorted(got) and [x for _, _, x in got if x] == expected, (data, split)


def test_small_files_share_a_task_and_large_ones_are_cut():
    plan = logs.planned([("a.jsonl", 10), ("b.json", 1000), ("c.log", 250), ("d.txt", 0)], 100, opening=1)
    pieces = sorted(r for p in plan for r in p.ranges)
    assert pieces == [("a.jsonl", 0, 10), ("b.json", 0, 1000), ("c.log", 0, 100), ("c.log", 100, 200), ("c.log", 200, 250), ("d.txt", 0, 0)]
    assert len(plan) < len(pieces)


def content(pick, depth=2):
    leaf = lambda: pick.choice(["plain words", "", " ", "café 日", None, 7, 2.5, True, "x\ny", 1e22, "😀"])
    kind = pick.randint(0, 9)
    if depth == 0 or kind < 3:
        return leaf()
    if kind < 7:
        return [content(pick, depth - 1) for _ in range(pick.randint(0, 3))]
    keys = ["type", "text", "role", "name", "content", "message", "output", "arguments", "tool_calls", "other"]
    out = {k: content(pick, depth - 1) for k in pick.sample(keys, pick.randint(0, 4))}
    if pick.random() < 0.5:
        out |= {"type": pick.choice(["text", "output_text", "tool_use", "Function_Call", 3]), "text": pick.choice(["said", "", "again", 4])}
    return out


def record(pick):
    roles = ["assistant", "User", "system", "tool", "human", None, 3, "agent_message"]
    part = lambda: {k: content(pick) for k in pick.sample(["content", "message", "summary", "text"], pick.randint(0, 2))} | ({"role": pick.choice(roles)} if pick.random() < 0.6 else {}) | ({"type": pick.choice(["agent_x", "user_y", "message"])} if pick.random() < 0.4 else {})
    out = {}
    if pick.random() < 0.4:
        out["payload"] = pick.choice([part(), part(), "text", None])
    if pick.random() < 0.4:
        out["message"] = pick.choice([part(), part(), content(pick)])
    for k in pick.sample(["content", "text", "summary", "body", "role", "type"], pick.randint(0, 3)):
        out[k] = pick.choice(roles) if k in ("role", "type") else content(pick)
    if pick.random() < 0.5:
        spot = pick.choice([out, out, out.get("payload"), out.get("message")])
        if isinstance(spot, dict):
            spot[pick.choice(["timestamp", "time", "date", "created_at"])] = pick.choice([" 2026-01-01T00:00:00Z ", "", 5, "later"])
    if pick.random() < 0.1 and isinstance(out.get("payload"), dict):
        out["payload"]["snapshot"] = {"timestamp": "deep"}
    return out if pick.random() < 0.93 else pick.choice(["just text", 7, None, [1, "a"], True])


def a_log(pick):
    """(suffix, content)."""
    some = [record(pick) for _ in range(pick.randint(1, 12))]
    if pick.random() < 0.3:
        key = pick.choice(["messages", "turns", "items", "else"])
        whole = pick.choice([some, {key: some}, {"a": 1, "records": 5, "items": some}, some[0], "only text", 5, None])
        return ".json", pick.choice([json.dumps(whole), json.dumps(whole, indent=1), json.dumps(whole, ensure_ascii=False)]) if pick.random() < 0.95 else '{"bad": '
    lines = [json.dumps(r, ensure_ascii=pick.random() < 0.5) for r in some]
    for _ in range(pick.randint(0, 2)):
        odd = ['{"text": "one", "text": "two"}', '{"text": NaN}', '{"text": "b"} trailing', "not json", "", "1] x", '{"text": 1e400}', '{"text": 123456789012345678901234567890123456789012}', " \t", "true story", '{"text": "\t"}']
        lines.insert(pick.randint(1, len(lines)), pick.choice(odd))
    if pick.random() < 0.15:
        lines = ["intro", "", "USER:  do it", "more: text", "agent: ok", "  assistant:", "fine ", *lines]
    return pick.choice([".jsonl", ".log", ".txt", ""]), pick.choice(["\n", "\r\n"]).join(lines)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def fixture():
    pick = random.Random(5)
    return [(f"log{k:03}", *a_log(pick)) for k in range(160)] + [("blank", ".txt", " \n "), ("bom", ".jsonl", '﻿{"text": "x"}'), ("first", ".jsonl", '{"text": "a", "text": "b"}\n{"text": "c"}')]


@pytest.mark.parametrize("skip_tools", [True, False])
def test_variant_reads_as_python_does(spark, fixture, skip_tools):
    files = spark.createDataFrame([(n, f"/x/{n}{s}", c) for n, s, c in fixture], "trace_id string, path string, content string")
    parsed = traces.parsed(files, skip_tools)
    lines = records.lines_of(files)
    told = records.told(lines, skip_tools)
    assert rows(records.messages_of(told)) == rows(traces.messages_of(parsed))
    assert rows(records.errors_of(told)) == rows(traces.errors_of(parsed))
    assert rows(records.heads_of(lines)) == rows(traces.heads_of(parsed))


def test_plain_records_need_no_python(spark):
    said = lambda k: json.dumps({"type": "response_item", "timestamp": "T", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": f"word {k}"}, {"type": "tool_call", "name": "x"}]}})
    files = spark.createDataFrame([(n, "/x/a.jsonl", "\n".join(said(k) for k in range(5))) for n in "ab"], "trace_id string, path string, content string")
    messages = records.messages_of(records.told(records.lines_of(files)))
    plan = messages._jdf.queryExecution().executedPlan().toString()
    assert messages.count() == 10 and "InPandas" not in plan and "Python" not in plan


def test_the_source_gives_the_records_of_whole_files(spark, fixture, tmp_path):
    for n, s, c in fixture:
        (tmp_path / f"{n}{s}").write_bytes(c.encode("utf-8", "replace").replace(b"caf", b"caf\xff"))
    (tmp_path / "_SUCCESS").write_text("{}")
    (tmp_path / ".codex").mkdir()
    (tmp_path / ".codex" / "rollout.jsonl").write_text('{"text": "hello"}')
    whole = traces.read(spark, str(tmp_path)).withColumn("trace_id", F.col("path"))
    parsed = traces.parsed(whole)
    for split in (1999, 1 << 20):
        lines = logs.scan(spark, str(tmp_path), split)
        told = records.told(lines)
        hidden = lambda df: df.where(~F.col("trace_id").contains("/.codex/"))  # noqa: E731  Spark's own listing passes such folders by
        assert rows(hidden(records.messages_of(told))) == rows(traces.messages_of(parsed))
        assert rows(hidden(records.heads_of(lines))) == rows(traces.heads_of(parsed))
        assert lines.where("trace_id LIKE '%/.codex/%'").count() == 1


def test_a_log_of_lines_is_read_by_several_tasks(spark, tmp_path):
    letters = string.ascii_lowercase
    lines = [json.dumps({"role": "assistant", "content": letters * (k % 7) + str(k)}) for k in range(500)]
    (tmp_path / "long.jsonl").write_text("\n".join(lines))
    scanned = logs.scan(spark, str(tmp_path), 4096)
    by_task = scanned.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.min("at").alias("first"), F.max(F.col("at") + F.length("line")).alias("last")).orderBy("first").collect()
    assert len(by_task) > 8 and scanned.rdd.getNumPartitions() == len(by_task)
    assert any(r["last"] > 4096 * (k + 1) for k, r in enumerate(by_task))  # a record across a boundary
    assert [r["line"] for r in scanned.orderBy("at").collect()] == lines


def test_options_of_the_source(spark, tmp_path):
    (tmp_path / "a.log").write_text('"x"')
    (tmp_path / "b.txt").write_text('"y"')
    assert logs.scan(spark, f"{tmp_path}/*.log").count() == 1
    assert logs.scan(spark, f"file://{tmp_path}/b.txt").first()["line"] == '"y"'
    with pytest.raises(Exception, match="splitBytes"):
        logs.scan(spark, str(tmp_path), 0).count()
    with pytest.raises(Exception, match="nowhere"):
        logs.scan(spark, f"{tmp_path}/nowhere").count()
    assert logs.reachable(str(tmp_path)) and not logs.reachable("viewfs://store/in")


def test_both_ways_of_reading_analyse_alike(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role": "assistant", "content": "The test failed with an error."}\n{"role": "assistant", "content": "Instead I will try another."}')
    (tmp_path / "b.json").write_text("{")
    split, whole = analyze_files(spark, str(tmp_path)), analyze_files(spark, str(tmp_path), split=False)
    for name in ("messages", "errors", "reports", "narratives", "views"):
        assert rows(split[name].drop("redactions")) == rows(whole[name].drop("redactions")), name
