"""Session logs: shapes of records, formats of files, agents."""

import json

from pyspark.sql import functions as F

from tracewright.plans.analysis import analyze_files
from tracewright.sources import traces


def parse(spark, content, path="/x/log.jsonl", **options):
    files = spark.createDataFrame([("t", path, content)], "trace_id string, path string, content string")
    records = traces.records(files)
    rows = traces.messages(records, **options).orderBy("msg_index").collect()
    at_once = traces.messages_of(traces.parsed(files, options.get("skip_tools", True)), options.get("include_user", True))
    assert at_once.orderBy("msg_index").collect() == rows  # with records stored between or not
    return [(r["role"], r["text"], r["timestamp"]) for r in rows], traces.agents(records, files).first()["agent"]


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)


def test_payload_records_drop_tool_calls(spark):
    said = lambda role, *parts: {"timestamp": "2026-06-06T10:00:00Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": list(parts)}}
    content = lines(
        {"type": "session_meta", "payload": {"originator": "codex_cli"}},
        said("assistant", {"type": "output_text", "text": "I will look."}, {"type": "tool_call", "name": "read", "arguments": "secret.py"}),
        said("user", {"type": "input_text", "text": "Go on."}),
    )
    found, agent = parse(spark, content)
    assert found == [("assistant", "I will look.", "2026-06-06T10:00:00Z"), ("user", "Go on.", "2026-06-06T10:00:00Z")]
    assert agent == "codex"
    assert [r for r, _, _ in parse(spark, content, include_user=False)[0]] == ["assistant"]


def test_message_records(spark):
    content = lines({"parentUuid": None, "sessionId": "s", "type": "assistant", "timestamp": "T", "message": {"role": "assistant", "content": [{"type": "text", "text": "Hello"}]}})
    assert parse(spark, content) == ([("assistant", "Hello", "T")], "claude_code")


def test_documents_and_odd_records(spark):
    wrapped = json.dumps({"turns": [{"role": "human", "content": "a"}, {"role": "system", "text": "b", "body": "b"}, 7, None, {"role": "user", "content": {"content": ["x", {"text": " "}, True]}}]})
    found, agent = parse(spark, wrapped, "/x/doc.json")
    assert [x[:2] for x in found] == [("user", "a"), ("assistant", "b"), ("assistant", "7"), ("assistant", "None"), ("user", "x\n\nTrue")]
    assert agent == "unknown"
    assert [x[1] for x in parse(spark, '"just this"', "/x/doc.json")[0]] == ["just this"]
    assert [x[1] for x in parse(spark, '{"a": 1, "text": "one", "text": "two"}', "/x/doc.json")[0]] == ["two"]


def test_lines_that_are_not_json(spark):
    found, _ = parse(spark, '\n{"text": "a"}\nnot json\n{"text": NaN}\n{"text": "b"} trailing')
    assert [x[1] for x in found] == ["a", "not json", "nan", '{"text": "b"} trailing']


def test_plain_transcripts(spark):
    found, _ = parse(spark, "intro\n\nUSER:  do it\nmore: text\nagent: ok\n  assistant:\nfine \n", "/x/a.txt")
    assert [x[:2] for x in found] == [("assistant", "intro"), ("user", "do it\nmore: text"), ("assistant", "ok"), ("assistant", "fine")]


def test_paths_tell_the_agent_first(spark):
    record = '{"type": "session_meta"}'
    assert parse(spark, record, "/a/.codex/x.jsonl")[1] == "codex"
    assert parse(spark, record, "/a/My-Claude.jsonl")[1] == "claude_code"
    assert parse(spark, record, "/a/b.pickle")[1] == "pi"
    assert parse(spark, '{"text": "I am a Pi Agent"}')[1] == "pi"


def test_bad_files_do_not_stop_good_ones(spark, tmp_path):
    (tmp_path / "good.jsonl").write_bytes(b'{"role": "assistant", "content": "It works \xff now."}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "blank.txt").write_text(" \n ")
    out = analyze_files(spark, str(tmp_path))
    errors = {r["trace_id"].rsplit("/", 1)[1]: r["error"] for r in out["errors"].collect()}
    assert set(errors) == {"bad.json", "blank.txt"} and errors["blank.txt"] == "The uploaded trace is empty."
    row = out["messages"].first()
    assert row["text"] == "It works \ufffd now."
    report = out["reports"].first()["report"]
    assert "Agent trace: good" in report and "No difficulty timeline was detected." in report


def test_sample_session(spark, tmp_path):
    """A four-message session, worked out by hand."""
    said = [
        ("user", "Please fix the failing login for jo@example.com and verify it.", "10:00:00"),
        ("assistant", "I will inspect the handler. The issue is not where I expected. But the token gh" + "p_" + "x" * 24 + " is old.", "10:00:10"),
        ("assistant", "It turns out the assumption was wrong, so I will narrow the change instead.", "10:01:00"),
        ("assistant", "Fixed the guard. The deployed path needs verification.", "10:02:52"),
    ]
    records = [{"timestamp": f"2026-06-06T{t}Z", "type": "response_item", "payload": {"type": "message", "role": r, "content": [{"type": "output_text", "text": x}]}} for r, x, t in said]
    (tmp_path / "sample.jsonl").write_text(lines(*records))
    out = analyze_files(spark, str(tmp_path))
    e = out["episodes"].collect()
    assert len(e) == 1 and e[0]["episode_id"] == "E01" and (e[0]["start_index"], e[0]["end_index"]) == (1, 3)
    assert e[0]["reported_difficulty"] == "The issue is not where I expected." and e[0]["difficulty_type"] == "localization_difficulty"
    assert (e[0]["outcome_claim"], e[0]["recovery_pattern"], e[0]["duration_label"]) == ("needs_verification", "partial_recovery", "2m 42s")
    facts = out["traces"].first()
    assert facts["redaction_count"] == 2 and facts["agent"] == "codex"
    assert "Redactions applied: GitHub token (1), email address (1)." in facts["privacy_notes"]
    assert "[REDACTED_EMAIL]" in out["narratives"].first()["narrative"]
    view = json.loads(out["views"].first()["view"])
    assert view["verdict"]["tone"] == "partial" and view["verdict"]["honesty"] == "candid" and view["captured"] == "2026-06-06 · 10:00–10:02 UTC"
    report = out["reports"].first()["report"]
    for part in ("## Journey Timeline", "## Difficulty Map", "## Outcome Claim Audit", "**Tone:** `partial`"):
        assert part in report
    assert out["episodes"].select(F.size("evidence_quotes")).first()[0] == 3
