"""The whole analysis of many traces: messages, redaction, episodes, summaries, report, view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.functions.times import wall
from tracewright.operators import episodes as E
from tracewright.operators import model as M
from tracewright.operators import summary as S
from tracewright.operators.messages import dealt, narrative, sampled, trace_title
from tracewright.operators.redaction import two_passes
from tracewright.operators.report import model_status, privacy_notes, reports
from tracewright.plans.figures import Figures
from tracewright.sources import records
from tracewright.sources import traces as files_source
from tracewright.sources.scratch import stored

#: Share of the work done after each stage: stage, step, percent (fixed values); redaction ramps from 12 to 40.
PLAN = (("extract", 2, 12), ("chart", 4, 55), ("classify", 5, 62), ("synthesize", 5, 70))
RAMP, CHUNKS = (12, 40), 30


def trace_facts(redacted: DataFrame, redact_secrets: bool = True, without_tools: bool = True) -> DataFrame:
    """trace_id, n_messages, redaction_count, privacy_notes of messages as two_passes gives them: one group-by, with a sum for each label."""
    labels = list(dict.fromkeys([label for label, _, _ in V.REDACTIONS] + [name for _, name in V.PERSONAL.values()]))
    sums = [F.sum(F.coalesce(F.try_element_at("redactions", F.lit(label)), F.lit(0))).alias(f"n{k}") for k, label in enumerate(labels)]
    facts = redacted.groupBy("trace_id").agg(F.count("*").alias("n_messages"), F.sum("redaction_count").alias("redaction_count"), F.bool_or("screened").alias("screened"), F.max("detector_error").alias("error"), *sums)
    counted = F.array(*[F.struct(F.lit(label).alias("key"), F.col(f"n{k}").alias("value")) for k, label in enumerate(labels)])
    counts = F.map_from_entries(F.filter(counted, lambda p: p["value"] > 0))
    return facts.withColumn("counts", counts).select("trace_id", "n_messages", "redaction_count", privacy_notes(F.col("counts"), F.col("screened"), F.col("error"), redact_secrets, without_tools).alias("privacy_notes"))


def analyze(
    messages: DataFrame, titles: DataFrame | None = None, detector: Callable[[list[str]], list[list[dict]]] | None = None, model: Callable[[str], str] | None = None, engine: str = "deterministic",
    redact_secrets: bool = True, without_tools: bool = True, figures: Figures | None = None, detector_profile: ResourceProfile | None = None, model_profile: ResourceProfile | None = None,
) -> dict[str, DataFrame]:
    """Relations of the analysis by name; titles (trace_id, agent, trace_title) where known.

    Secrets are redacted by patterns, then personal data by the detector's spans, before anything is scored. With an engine other than the rules, `model`
    answers a prompt for each trace: a sound answer's episodes, patterns and verdict take the place of the rules' ones in reports and views; of any other answer, and of an
    engine that nobody knows, a note says why the rules' result stands. Redacted messages, answers and episodes, which the other relations
    read, are written at once; the rest is lazy. `figures` observes these writes. The stages of detector and model run with their resource profiles, where there are any.
    """
    figures = figures or Figures()
    messages = figures.watch("extract", messages, "text")
    if redact_secrets:
        redacted = two_passes(messages, detector, profile=detector_profile)
    else:
        none = {"redactions": F.create_map().cast("map<string,bigint>"), "redaction_count": F.lit(0).cast("long"), "screened": F.lit(False), "detector_error": F.lit(None).cast("string")}
        redacted = messages.withColumns(none)
    with figures.timed("extract", "redact"):
        redacted = stored(figures.watch("redact", redacted, "text", "redaction_count"), "messages")
    rows = redacted.count()
    with figures.timed("chart", "classify"):
        charted = figures.watch("chart", E.combined(dealt(redacted, rows, "trace_id")), "combined")
        found = stored(figures.watch("classify", E.described(charted).select(*E.COLUMNS), "reported_difficulty"), "episodes")
    facts = trace_facts(redacted, redact_secrets, without_tools)
    named = facts.join(titles, "trace_id", "left") if titles is not None else facts.withColumns({"agent": F.lit(None).cast("string"), "trace_title": F.lit(None).cast("string")})
    unnamed = F.concat(F.lit("Agent trace: "), F.col("trace_id").cast("string"))
    traces = named.withColumns({"agent": F.coalesce("agent", F.lit("unknown")), "trace_title": F.coalesce("trace_title", unnamed)})
    answers = None
    if engine in V.MODELS and V.MODELS[engine]:
        if model is None:
            raise ValueError(f"engine {engine!r} needs a model")
        answers = stored(M.parsed(M.generate(M.prompts(sampled(redacted, rows=rows), found, traces), model, model_profile)), "answers")
        found = stored(M.take_over(found, answers, redacted, rows), "episodes-taken-over")
    full = whole(traces, found, engine, answers)
    return {
        "messages": redacted, "episodes": found, "traces": full.drop("e"), "narratives": narrative(redacted), "reports": reports(full), "views": views(full), "episodes_json": episodes_json(full),
    }


def whole(traces: DataFrame, episodes: DataFrame, engine: str = "deterministic", answers: DataFrame | None = None) -> DataFrame:
    """A row for each trace, with all that reports and views tell: the columns of `traces`, e (its episodes in order, [] without any), patterns (a map), verdict
    (tone, headline, detail, honesty), engine and model_notes. One exchange of episodes; a model's words go before the rules'."""
    listed = traces.join(S.by_trace(episodes), "trace_id", "left").withColumn("some", F.size(F.coalesce("e", F.array())) > 0)
    pairs = lambda values: F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[c if isinstance(c, Column) else F.lit(c) for c in values.values()]))
    told = listed.withColumn("patterns", F.when(F.col("some"), pairs(S.styles())).otherwise(pairs(V.NO_PATTERNS)))
    if answers is not None:
        said = answers.select("trace_id", F.when(F.size("answer.patterns") > 0, F.col("answer.patterns")).alias("model_patterns"))
        said = said.join(M.model_verdict(answers).select("trace_id", F.struct("tone", "headline", "detail", "honesty").alias("model_verdict")), "trace_id", "left").join(M.engine_notes(engine, answers), "trace_id", "left")
        told = told.join(said, "trace_id", "left").withColumn("patterns", F.coalesce("model_patterns", "patterns")).drop("model_patterns")
    else:
        notes = F.array().cast("array<string>") if engine in V.MODELS else M.engine_notes(engine, None)
        told = told.withColumns({"model_verdict": F.lit(None).cast("struct<tone:string,headline:string,detail:string,honesty:string>"), "engine": F.lit(None).cast("string"), "model_notes": notes})
    rated = S.rated()
    text = lambda name: F.coalesce(F.try_element_at("patterns", F.lit(name)), F.lit(""))
    own = F.struct(rated["tone"].alias("tone"), rated["headline"].alias("headline"), S.verdict_detail(F.size("e"), text("recovery_style"), text("risk_or_caveat")).alias("detail"), rated["honesty"].alias("honesty"))
    bare = F.struct(*[F.lit(v).alias(k) for k, v in zip(("tone", "headline", "detail", "honesty"), V.NO_EPISODE, strict=True)])
    verdict = F.coalesce("model_verdict", F.when(F.col("some"), own).otherwise(bare))
    empty = F.array().cast(told.schema["e"].dataType)
    return told.withColumns({
        "verdict": verdict, "e": F.coalesce("e", empty), "engine": F.coalesce("engine", F.lit(V.RULE_ENGINE)), "model_notes": F.coalesce("model_notes", F.array().cast("array<string>")),
    }).drop("model_verdict", "some")


def analyze_files(spark: SparkSession, path: str, include_user: bool = True, skip_tools: bool = True, originals: DataFrame | None = None, split: bool | None = None, **options) -> dict[str, DataFrame]:
    """The analysis of all session logs under a path (options as of `analyze`); originals (trace_id, original) where logs were handed over under names of their own.

    Logs are read by the source `session_logs`, long ones by several tasks, or, where only Spark reaches the store or `split` is False, as whole files. Lines and what
    records say are written once, and errors (trace_id, error) of logs that cannot be read stand among the relations.
    """
    lines = stored(records.lines_at(spark, path, whole=None if split is None else not split), "lines")
    told = records.told(lines, skip_tools)
    paths = lines.select("trace_id", F.col("trace_id").alias("path")).distinct()
    agents = files_source.agents(records.heads_of(lines), paths)
    known = agents.join(originals, "trace_id", "left") if originals is not None else agents.withColumn("original", F.lit(None).cast("string"))
    titles = known.select("trace_id", "agent", trace_title(F.col("agent"), files_source.stem(F.col("trace_id")), F.col("original")).alias("trace_title"))
    return analyze(records.messages_of(told, include_user), titles, without_tools=skip_tools, **options) | {"errors": records.errors_of(told)}


def shown(clock) -> Column:
    """The episodes in column e with the fields that outputs show; `clock` says how times are told."""
    fields = [c for c in E.COLUMNS if c not in ("trace_id", "episode_no", "start_index", "end_index", "start_time", "end_time", "duration_label")]
    span = lambda x: F.struct(x["start_index"].alias("start_index"), x["end_index"].alias("end_index"), clock(x["start_time"]).alias("start_time"), clock(x["end_time"]).alias("end_time"), x["duration_label"].alias("duration_label"))
    order = {c: k for k, c in enumerate(("episode_id", "title"))}
    first, rest = [f for f in fields if f in order], [f for f in fields if f not in order]
    return F.transform("e", lambda x: F.struct(*[x[f].alias(f) for f in first], span(x).alias("message_span"), *[x[f].alias(f) for f in rest]))


def views(full: DataFrame) -> DataFrame:
    """trace_id, view: what a front end shows, as JSON; model_status is what it says of the model ('' where none was asked)."""
    clock = lambda c: F.coalesce(F.substring(wall(c), 12, 8), c, F.lit(""))
    none, some, notes = F.lit("—"), F.size("e") > 0, F.concat("privacy_notes", "model_notes")
    seen = {name: F.when(some, c).otherwise(none).alias(name) for name, c in S.window().items()}
    view = F.struct(
        "trace_title", F.col("agent").alias("agent_type_guess"), F.lit(V.SCOPE).alias("analysis_scope"), "engine", seen["captured"], F.col("n_messages").alias("narrative_message_count"), "redaction_count",
        seen["duration_total"], "verdict", F.col("patterns").alias("overall_patterns"), notes.alias("privacy_notes"), shown(clock).alias("episodes"), model_status(notes).alias("model_status"),
        *[c.alias(name) for name, c in S.selection().items()],
    )
    return full.select("trace_id", F.to_json(view, {"ignoreNullFields": "false"}).alias("view"))


def episodes_json(full: DataFrame) -> DataFrame:
    """trace_id, json: the whole result of a trace, as a file of its own; times as the log has them."""
    base = F.struct(
        "trace_title", F.col("agent").alias("agent_type_guess"), F.lit(V.SCOPE).alias("analysis_scope"), "privacy_notes", shown(lambda c: c).alias("episodes"), F.col("patterns").alias("overall_patterns"),
        F.col("n_messages").alias("narrative_message_count"), "redaction_count", "engine", "model_notes", F.col("verdict").alias("session_verdict"),
    )
    return full.select("trace_id", F.to_json(base, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def progress(messages: DataFrame) -> DataFrame:
    """trace_id, ordinal, stage, step, pct, processed, total: the events a run over each trace reports."""
    n = messages.groupBy("trace_id").agg(F.count("*").alias("total"))
    chunk = F.greatest(F.lit(1), F.ceil(F.col("total") / CHUNKS)).cast("long")
    low, high = RAMP
    ramp = n.withColumn("chunk", chunk).select("trace_id", "total", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("total") / F.col("chunk"))), lambda k: F.least(k * F.col("chunk"), F.col("total")))).alias("processed"))
    redacting = ramp.select(
        "trace_id", (F.lit(1000).cast("long") + F.col("processed")).alias("key"), F.lit("redact").alias("stage"), F.when(F.col("processed") < F.col("total"), 2).otherwise(3).alias("step"),
        F.bround(low + (high - low) * (F.col("processed") / F.col("total")), 0).cast("int").alias("pct"), "processed", "total",
    )
    stages = F.array(*[F.struct(F.lit(k * 10**12).cast("long").alias("key"), F.lit(s).alias("stage"), F.lit(step).alias("step"), F.lit(pct).alias("pct")) for k, (s, step, pct) in enumerate(PLAN)])
    fixed = n.select("trace_id", F.inline(stages), F.col("total").alias("processed"), "total")
    return redacting.unionByName(fixed).select("trace_id", "key", "stage", "step", "pct", "processed", "total")
