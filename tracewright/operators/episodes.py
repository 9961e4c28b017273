"""From messages to difficulty episodes.

Messages are rows (trace_id, msg_index, role, text, timestamp, source); msg_index is dense from 0 in each trace. All windows and groups
are by trace_id, so one exchange serves them all. A trace is one session's log and fits a task; traces are spread by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.functions import text as X
from tracewright.functions.times import duration_label
from tracewright.sources.scratch import stored

MOST_EPISODES = 12
#: What messages, sentences and whole episodes are searched for, each in one pass.
SIGNALS = X.Phrases(V.DIFFICULTY, V.SHIFT, V.INTENTION, V.OUTCOME)
TELLING = X.Phrases(V.DIFFICULTY, V.SHIFT, V.INTENTION, V.OUTCOME, V.EVIDENCE)
CLAIMS = (V.SUCCESS, V.UNRESOLVED, V.NOT_RESOLVED, V.UNVERIFIED, V.PARTIAL, V.CAVEAT, V.COMPLETION, V.UNCERTAIN)
CODES = X.Phrases(V.DIFFICULTY, *CLAIMS, *[phrases for rules in (V.DIFFICULTY_RULES, V.APPRAISAL_RULES, V.DETOUR_RULES, V.RESOLUTION_RULES) for _, phrases in rules])
TYPES = X.Phrases(*[phrases for _, phrases in V.DIFFICULTY_RULES])


def flagged(messages: DataFrame) -> DataFrame:
    """Messages with what they signal: difficulty_score, has_shift, has_intention, has_outcome, is_candidate."""
    has = lambda phrases: SIGNALS.any_of(F.col("__hits"), phrases)
    scored = messages.withColumn("__hits", SIGNALS.hits(F.lower("text"))).withColumns({
        "difficulty_score": SIGNALS.score(F.col("__hits"), V.DIFFICULTY), "has_shift": has(V.SHIFT), "has_intention": has(V.INTENTION), "has_outcome": has(V.OUTCOME),
    }).drop("__hits")
    return scored.withColumn("is_candidate", (F.col("role") == "assistant") & (F.col("difficulty_score") + F.col("has_shift").cast("int") >= 2))


def candidate_spans(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_index, start_index, end_index) for each candidate: back to the nearest intention of the two messages before, on to
    the first outcome of the three after, or the last assistant message among them."""
    agent, trace = F.col("role") == "assistant", Window.partitionBy("trace_id").orderBy("msg_index")
    nearest = F.max(F.when(agent & F.col("has_intention"), F.col("msg_index"))).over(trace.rowsBetween(-2, -1))
    outcome = F.min(F.when(agent & F.col("has_outcome"), F.col("msg_index"))).over(trace.rowsBetween(1, 3))
    last = F.max(F.when(agent, F.col("msg_index"))).over(trace.rowsBetween(0, 3))
    spans = flagged(messages).withColumns({"start_index": F.coalesce(nearest, "msg_index"), "end_index": F.coalesce(outcome, last)})
    return spans.where("is_candidate").select("trace_id", "msg_index", "start_index", "end_index")


def merged_spans(candidates: DataFrame, most: int = MOST_EPISODES) -> DataFrame:
    """(trace_id, episode_no, start_index, end_index): touching and overlapping spans joined, the first `most` of each trace."""
    order = Window.partitionBy("trace_id").orderBy("start_index", "end_index", "msg_index")
    reach = F.max("end_index").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = candidates.withColumn("opens", (reach.isNull() | (F.col("start_index") > reach + 1)).cast("int"))
    numbered = opened.withColumn("episode_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.where(F.col("episode_no") <= most).groupBy("trace_id", "episode_no")
    return merged.agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"))


def tagged(messages: DataFrame, most: int = MOST_EPISODES) -> DataFrame:
    """The messages inside spans, with episode_no: the rows of merged_spans' first `most` spans of each trace, told on the messages themselves.

    Indexes are dense, so joined spans are the runs of messages that some candidate's span covers, and a span reaches two messages back and three
    on at most. All windows share one order: no join, and one exchange for them and whatever groups by trace.
    """
    agent, trace = F.col("role") == "assistant", Window.partitionBy("trace_id").orderBy("msg_index")
    nearest = F.max(F.when(agent & F.col("has_intention"), F.col("msg_index"))).over(trace.rowsBetween(-2, -1))
    outcome = F.min(F.when(agent & F.col("has_outcome"), F.col("msg_index"))).over(trace.rowsBetween(1, 3))
    last = F.max(F.when(agent, F.col("msg_index"))).over(trace.rowsBetween(0, 3))
    candidate = F.col("is_candidate")
    spans = flagged(messages).withColumns({"__start": F.when(candidate, F.coalesce(nearest, "msg_index")), "__end": F.when(candidate, F.coalesce(outcome, last))})
    behind, ahead = F.max("__end").over(trace.rowsBetween(-3, 0)), F.min("__start").over(trace.rowsBetween(1, 2))
    covered = spans.withColumn("__in", F.coalesce(behind >= F.col("msg_index"), F.lit(False)) | F.coalesce(ahead <= F.col("msg_index"), F.lit(False)))
    opens = covered.withColumn("__opens", (F.col("__in") & ~F.lag("__in", 1, False).over(trace)).cast("int"))
    numbered = opens.withColumn("episode_no", F.sum("__opens").over(trace.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(F.col("__in") & (F.col("episode_no") <= most)).select(*messages.columns, "episode_no")


#: Messages of a segment; how far from it a message may lie that its own depend on.
SEGMENT, HALO = 50_000, 6


def segmented_spans(messages: DataFrame, most: int = MOST_EPISODES, segment: int = SEGMENT) -> DataFrame:
    """merged_spans of traces larger than a task: windows are by segments of a trace, each with the few messages around it, and what goes on beyond a segment is carried by sums.

    Whether a span covers a message depends on five messages to either side. So each segment tells by itself where covered runs begin; a first pass counts these
    by segment, running sums over the segments of a trace carry the numbers, and the second pass groups the covered messages by number. Indexes are dense.
    """
    if segment < HALO:
        raise ValueError(f"a segment has {HALO} messages at least")
    own, place = F.expr(f"msg_index div {segment}"), F.col("msg_index") % segment
    homes = F.array_compact(F.array(own, F.when((place < HALO) & (own > 0), own - 1), F.when(place >= segment - HALO, own + 1)))
    flags = flagged(messages).select("trace_id", "msg_index", "role", "is_candidate", "has_intention", "has_outcome", own.alias("__own"), F.explode(homes).alias("__segment"))
    agent, part = F.col("role") == "assistant", Window.partitionBy("trace_id", "__segment").orderBy("msg_index")
    nearest = F.max(F.when(agent & F.col("has_intention"), F.col("msg_index"))).over(part.rowsBetween(-2, -1))
    outcome = F.min(F.when(agent & F.col("has_outcome"), F.col("msg_index"))).over(part.rowsBetween(1, 3))
    last = F.max(F.when(agent, F.col("msg_index"))).over(part.rowsBetween(0, 3))
    spans = flags.withColumns({"__start": F.when(F.col("is_candidate"), F.coalesce(nearest, "msg_index")), "__end": F.when(F.col("is_candidate"), F.coalesce(outcome, last))})
    behind, ahead = F.max("__end").over(part.rowsBetween(-3, 0)), F.min("__start").over(part.rowsBetween(1, 2))
    covered = spans.withColumn("__in", F.coalesce(behind >= F.col("msg_index"), F.lit(False)) | F.coalesce(ahead <= F.col("msg_index"), F.lit(False)))
    opens = covered.withColumn("__opens", (F.col("__in") & ~F.lag("__in", 1, False).over(part) & (F.col("__own") == F.col("__segment"))).cast("long"))
    numbered = opens.withColumn("__local", F.sum("__opens").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    inside = numbered.where(F.col("__in") & (F.col("__own") == F.col("__segment")))
    # a row for each run of a segment; its first may go on from the segment before
    runs = stored(inside.groupBy("trace_id", "__segment", "__local").agg(F.min("msg_index").alias("start_index"), F.max("msg_index").alias("end_index")), "runs")
    counts = runs.groupBy("trace_id", "__segment").agg(F.max("__local").alias("n"))
    before = Window.partitionBy("trace_id").orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)  # one row for each segment that has a run
    carried = counts.select("trace_id", "__segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = runs.join(carried, ["trace_id", "__segment"]).withColumn("episode_no", F.col("__local") + F.col("__before")).where(F.col("episode_no") <= most)
    return placed.groupBy("trace_id", "episode_no").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"))


def span_messages(messages: DataFrame) -> DataFrame:
    """The assistant messages of each span, with episode_no."""
    return tagged(messages).where("role = 'assistant'")


def classified(df: DataFrame) -> DataFrame:
    """df (combined text, difficulty_sentence) with the seven codes."""
    hits = F.col("hits")
    d = lambda phrases: CODES.any_of(hits, phrases)
    found = {"low": F.lower("combined"), "hits": CODES.hits(F.lower("combined")), "said": TYPES.hits(F.lower("difficulty_sentence"))}
    first = df.withColumns(found).withColumns({
        "by_sentence": TYPES.first_rule(F.col("said"), V.DIFFICULTY_RULES), "by_all": CODES.first_rule(hits, V.DIFFICULTY_RULES), "appraisal": CODES.first_rule(hits, V.APPRAISAL_RULES),
        "detour": CODES.first_rule(hits, V.DETOUR_RULES), "resolution_mode": CODES.first_rule(hits, V.RESOLUTION_RULES), "score": CODES.score(hits, V.DIFFICULTY), "success": d(V.SUCCESS),
    })
    confident = X.contains_one(F.col("low"), V.CONFIDENT_SUBSTRINGS)
    second = first.withColumns({
        "difficulty_type": F.when(F.col("by_sentence") != "unknown", F.col("by_sentence")).otherwise(F.col("by_all")),
        "detour_type": F.when((F.col("detour") == "unknown") | ((F.col("detour") == "premature_closure") & (F.col("score") < 2)), "direct_continuation").otherwise(F.col("detour")),
        "outcome_claim": F.when(F.col("success") & d(V.UNRESOLVED), "premature_success_claim").when(d(V.NOT_RESOLVED), "not_resolved").when(d(V.UNVERIFIED), "needs_verification")
        .when(d(V.PARTIAL), "partially_resolved").when(d(V.CAVEAT) & d(V.COMPLETION), "resolved_with_caveat").when(F.col("success") & (F.col("score") >= 3) & ~confident, "premature_success_claim")
        .when(F.col("success"), "resolved_with_confidence").when(d(V.UNCERTAIN), "uncertain_but_proceeding").otherwise("unknown"),
    })
    claim, turn = F.col("outcome_claim"), F.col("detour_type")
    third = second.withColumn(
        "recovery_pattern",
        F.when(claim == "not_resolved", "failed_recovery").when(claim == "needs_verification", "partial_recovery").when(claim == "premature_success_claim", "overconfident_recovery")
        .when(X.contains_one(F.col("low"), V.REFLECTIVE_SUBSTRINGS), "reflective_recovery")
        .when(turn.isin("alternative_path", "workaround", "scope_narrowing", "verification_shift"), "detour_recovery")
        .when(X.contains_one(F.col("low"), V.ITERATIVE_SUBSTRINGS), "iterative_recovery")
        .when(claim.isin("resolved_with_confidence", "resolved_with_caveat"), "smooth_recovery").otherwise("unknown"),
    )
    productive = (
        F.when(turn.isin("direct_continuation", "unknown"), "unknown").when(F.col("recovery_pattern").isin("overconfident_recovery", "failed_recovery", "avoidant_recovery"), "no")
        .when(claim.isin("partially_resolved", "needs_verification", "resolved_with_caveat"), "mixed").otherwise("yes")
    )
    return third.withColumn("productive_detour", productive).drop("low", "hits", "said", "by_sentence", "by_all", "detour", "score", "success")


def key_sentences(df: DataFrame) -> DataFrame:
    """df (combined) with its sentences and those that tell: intention, difficulty, shift, outcome; '' where none does."""
    s, kinds = F.col("sentences"), {"d": V.DIFFICULTY, "i": V.INTENTION, "h": V.SHIFT, "o": V.OUTCOME, "e": V.EVIDENCE}
    said = F.transform("sentences", lambda x: F.struct(x.alias("text"), TELLING.hits(F.lower(x)).alias("hits")))
    told = F.transform("__said", lambda x: F.struct(x["text"].alias("text"), *[TELLING.any_of(x["hits"], phrases).alias(k) for k, phrases in kinds.items()]))
    # once as a whole each, so that no sentence is searched twice
    df = df.withColumn("sentences", X.sentences(F.col("combined"))).withColumn("__said", said).withColumn("__told", told)
    those = lambda kept: F.transform(F.filter("__told", kept), lambda x: x["text"])
    difficult = F.coalesce(F.get(those(lambda x: x["d"] & (~x["i"] | x["e"])), 0), F.get(those(lambda x: x["d"]), 0), F.get(s, 0), F.lit(""))
    df = df.withColumns({"difficulty_sentence": difficult, "own_intention": X.first_of(those(lambda x: x["i"])), "outcome_sentence": X.last_of(those(lambda x: x["o"])), "__shifts": F.filter("__told", lambda x: x["h"])})
    # the first shift behind the difficulty; behind the first sentence equal to it, as sentences may repeat
    later = F.get(F.filter(F.transform("__told", lambda x, k: F.struct(x["text"].alias("text"), (x["h"] & (k >= F.array_position(s, F.col("difficulty_sentence")))).alias("later"))), lambda x: x["later"]), 0)["text"]
    return df.withColumns({
        "intention": F.when(F.col("own_intention") != "", F.col("own_intention")).otherwise(X.first_of(s)), "shift_sentence": F.coalesce(later, F.get("__shifts", F.lit(0))["text"], F.lit("")),
    }).drop("__said", "__told", "__shifts")


def combined(messages: DataFrame) -> DataFrame:
    """A row for each episode: its span, the texts of its assistant messages in order, and the times of the first and last."""
    said = F.collect_list(F.when(F.col("role") == "assistant", F.struct("msg_index", "text", "timestamp")))
    grouped = tagged(messages).groupBy("trace_id", "episode_no")
    ordered = grouped.agg(F.min("msg_index").alias("start_index"), F.max("msg_index").alias("end_index"), F.array_sort(said).alias("said"))
    ends = {"start_time": F.get("said", F.lit(0))["timestamp"], "end_time": F.get("said", F.size("said") - 1)["timestamp"]}
    return ordered.withColumns({"combined": F.array_join(F.transform("said", lambda m: m["text"]), "\n\n"), **ends}).drop("said")


COLUMNS = (
    "trace_id", "episode_no", "episode_id", "title", "start_index", "end_index", "start_time", "end_time", "duration_label", "initial_intention", "reported_difficulty", "difficulty_type",
    "appraisal", "strategy_before", "strategy_after", "detour_type", "resolution_mode", "recovery_pattern", "outcome_claim", "productive_detour", "evidence_quotes", "analyst_memo",
)


def episodes(messages: DataFrame) -> DataFrame:
    """One row for each difficulty episode, with COLUMNS; evidence_quotes is an array of three at most."""
    return described(combined(messages)).select(*COLUMNS)


def described(spans: DataFrame) -> DataFrame:
    """spans as `combined` gives them, with their codes and texts."""
    told = classified(key_sentences(spans))
    quotes = F.transform(F.filter(F.array("difficulty_sentence", "shift_sentence", "outcome_sentence"), lambda s: s != ""), lambda s: X.trim_words(s, 30))
    said = lambda c: X.spoken(F.col(c))
    topic = X.trim_words(F.col("difficulty_sentence"), 8)
    label = F.initcap(said("difficulty_type"))
    strategy = F.when(F.col("shift_sentence") != "", F.col("shift_sentence")).when(F.col("outcome_sentence") != "", F.col("outcome_sentence")).otherwise(V.NO_SHIFT)
    memo = F.format_string(
        "The visible narrative frames this as %s; the appraisal is %s, with %s and %s. The outcome claim reads as %s.",
        said("difficulty_type"), said("appraisal"), said("detour_type"), said("recovery_pattern"), said("outcome_claim"),
    )
    return told.withColumns({
        "episode_id": episode_id(F.col("episode_no")), "title": F.when(topic != "", F.concat(label, F.lit(": "), topic)).otherwise(label),
        "duration_label": duration_label(F.col("start_time"), F.col("end_time")), "initial_intention": X.trim_words(F.col("intention"), 36),
        "reported_difficulty": X.trim_words(F.col("difficulty_sentence"), 40),
        "strategy_before": F.when(F.col("own_intention") != "", X.trim_words(F.col("own_intention"), 36)).otherwise(V.NO_STRATEGY),
        "strategy_after": X.trim_words(strategy, 36), "evidence_quotes": F.slice(F.array_distinct(quotes), 1, 3), "analyst_memo": memo,
    })


def episode_id(number: Column) -> Column:
    return F.format_string("E%02d", number.cast("int"))
