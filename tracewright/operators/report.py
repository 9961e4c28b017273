"""The Markdown field report of each trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.functions.text import spoken
from tracewright.operators.summary import lookup

T = V.REPORT


def _joined(*parts, sep: str = "") -> Column:
    return F.concat_ws(sep, *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _filled(text: str, *values: Column) -> Column:
    return F.format_string(text, *[v.cast("string") for v in values])


def timeline(e: str) -> Column:
    block = lambda x: _joined(
        _joined("### ", x["episode_id"], " - ", x["title"]), _joined("**Tone:** `", lookup(V.REPORT_TONES, x["recovery_pattern"], "unknown"), "`"), _joined("**Intention:** ", x["initial_intention"]),
        _joined("**Difficulty:** ", x["reported_difficulty"]), _joined("**Shift:** ", x["strategy_after"]), _joined("**Resolution mode:** `", x["resolution_mode"], "`"),
        _joined("**Outcome claim:** `", x["outcome_claim"], "`"), _joined("**Duration:** ", x["duration_label"]), sep="\n",
    )
    return _joined("## Journey Timeline", F.array_join(F.transform(e, block), "\n\n"), sep="\n\n")


def difficulty_map(e: str) -> Column:
    """Difficulty types in order, each with its episodes and the first quote that one of them has."""

    def line(kind: Column) -> Column:
        own = F.filter(e, lambda x: x["difficulty_type"] == kind)
        quotes = F.flatten(F.transform(own, lambda x: F.slice(x["evidence_quotes"], 1, 1)))
        example = F.when(F.size(quotes) > 0, _joined('Example: "', F.get(quotes, F.lit(0)), '"')).otherwise(T["no_quote"])
        return _joined("- **", F.initcap(spoken(kind)), "**: ", F.array_join(F.transform(own, lambda x: x["episode_id"]), ", "), ". ", example)

    kinds = F.array_sort(F.array_distinct(F.col(f"{e}.difficulty_type")))
    return _joined("## Difficulty Map", "Main difficulties observed:", F.array_join(F.transform(kinds, line), "\n"), sep="\n")


def detours(e: str) -> Column:
    ids = lambda value: F.array_join(F.transform(F.filter(e, lambda x: x["productive_detour"] == value), lambda x: x["episode_id"]), ", ")
    held = lambda value: F.when(ids(value) != "", ids(value)).otherwise(T["none_detected"])
    turns = F.transform(F.filter(e, lambda x: x["detour_type"] != "direct_continuation"), lambda x: _joined("- ", x["episode_id"], ": `", x["detour_type"], "`. ", x["analyst_memo"]))
    head = F.array(F.lit("## Detour Analysis"), _joined("- **Productive detours:** ", held("yes")), _joined("- **Mixed detours:** ", held("mixed")), _joined("- **Unproductive or risky detours:** ", held("no")))
    return F.array_join(F.concat(head, turns), "\n")


def claims(e: str) -> Column:
    def line(x: Column) -> Column:
        quotes = F.array_join(F.transform(F.slice(x["evidence_quotes"], 1, 2), lambda q: _joined('"', q, '"')), "; ")
        evidence = F.when(quotes != "", quotes).otherwise(T["no_short_quote"])
        return _joined("- **", x["episode_id"], ":** `", x["outcome_claim"], "`. Recovery: `", x["recovery_pattern"], "`. Evidence: ", evidence, ".")

    return _joined("## Outcome Claim Audit", F.array_join(F.transform(e, line), "\n"), sep="\n")


def reports(whole: DataFrame) -> DataFrame:
    """trace_id, report for each row of `whole` (see analysis.whole): sections are read off the trace's episodes in its row."""
    c, some = F.col, F.size("e") > 0
    style = lambda name, default="": F.coalesce(F.try_element_at("patterns", F.lit(name)), F.lit(default))
    head = _joined(T["title"], _joined("**Trace:** ", c("trace_title")), _joined("**Agent guess:** `", c("agent"), "`"), f"**Analysis scope:** {V.SCOPE}", _joined("**Engine:** `", c("engine"), "`"), sep="\n\n")
    full = _joined(
        _filled(T["summary"], c("n_messages"), F.size("e")), style("difficulty_style"), style("detour_style"), style("recovery_style"), style("risk_or_caveat", T["no_caveat"]), T["disclaimer"], sep=" "
    )
    summary = _joined("## Executive Summary", F.when(some, full).otherwise(_filled(T["bare"], c("n_messages"))), sep="\n\n")
    memo = F.when(F.size("model_notes") > 0, F.array_join(F.concat(F.array(F.lit("## Model Memo"), F.lit("**Model notes:**")), F.transform("model_notes", lambda n: _joined("- ", n))), "\n\n"))
    recovery = _joined("## Recovery Pattern", _joined(style("recovery_style", T["no_recovery"]), style("difficulty_style"), style("detour_style"), sep=" "), sep="\n\n")
    notes = F.array_join(F.concat(F.array(F.lit("## Privacy Notes"), _filled("Redaction count: %s", c("redaction_count"))), F.transform("privacy_notes", lambda n: _joined("- ", n))), "\n")
    section = lambda told, text: F.when(some, told).otherwise(text)
    parts = [
        head, summary, memo, section(timeline("e"), T["no_timeline"]), section(difficulty_map("e"), T["no_map"]), section(detours("e"), T["no_detours"]), recovery, section(claims("e"), T["no_claims"]), notes,
    ]
    return whole.select("trace_id", F.concat(F.regexp_replace(_joined(*parts, sep="\n\n"), r"(?U)\A\s+|\s+\z", ""), F.lit("\n")).alias("report"))


def privacy_notes(counts: Column, screened: Column, error: Column, redacted: bool = True, without_tools: bool = True) -> Column:
    """The notes of a trace, from its map of label to count, whether a detector ran on it, and the error of one that failed (null if none did)."""
    labels = F.array_sort(F.map_keys(counts))
    listed = F.array_join(F.transform(labels, lambda k: F.concat(k, F.lit(" ("), F.try_element_at(counts, k).cast("string"), F.lit(")"))), ", ")
    note = V.PRIVACY_NOTES
    applied = F.when(F.size(labels) > 0, _filled(note["applied"], listed)).otherwise(note["none"])
    said = [F.lit(note["processing"]), F.lit(note["visible"]), *[F.lit(note["tools"])] * without_tools]
    said += [F.when(error.isNotNull(), _filled(note["unavailable"], error)), F.when(screened, F.lit(note["screened"])), applied] if redacted else [F.lit(note["disabled"])]
    return F.filter(F.array(*said), lambda n: n.isNotNull())


def model_status(notes: Column) -> Column:
    """What a front end says of the model, from a trace's notes: '' where none is about it, else whether it fell back, and those notes."""
    own = F.filter(notes, lambda n: n.rlike("^(" + "|".join(V.MODEL_NOTE_HEADS) + ")"))
    fell = F.exists(own, lambda n: n.rlike("(?i)" + "|".join(V.FALLBACK_PHRASES)))
    return F.when(F.size(own) > 0, _joined(F.when(fell, V.MODEL_STATUS[True]).otherwise(V.MODEL_STATUS[False]), F.array_join(own, " "), sep=" ")).otherwise("")
