"""Roll-ups of episodes to their trace: patterns, verdict, clusters, detours, capture window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.functions.text import spoken
from tracewright.functions.times import duration_label, instant, wall

AXES = ("difficulty_type", "detour_type", "recovery_pattern", "outcome_claim")


def lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def in_order(values: Column, when: Column | None = None) -> Column:
    """Aggregate: values of a trace's episodes as an array in the episodes' order."""
    pairs = F.collect_list(F.struct("episode_no", values.alias("v")) if when is None else F.when(when, F.struct("episode_no", values.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def code_counts(episodes: DataFrame) -> DataFrame:
    """(trace_id, axis, code, n, first_episode) over the four axes that are summed up."""
    stacked = episodes.select("trace_id", "episode_no", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("code")) for a in AXES])).alias("x"))
    return stacked.groupBy("trace_id", "x.axis", "x.code").agg(F.count("*").alias("n"), F.min("episode_no").alias("first_episode"))


def by_trace(episodes: DataFrame) -> DataFrame:
    """trace_id, e: the episodes of each trace in order, as an array of structs. A trace has a dozen of them, which all that is told of it then reads in its row."""
    return episodes.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("episode_no", *[c for c in episodes.columns if c not in ("trace_id", "episode_no")]))).alias("e"))


def styles(e: str = "e") -> dict[str, Column]:
    """difficulty_style, detour_style, recovery_style, risk_or_caveat of the episodes in column `e`. The three commonest codes are named; ties go to the one seen first."""

    def top(axis: str) -> Column:
        codes = F.col(f"{e}.{axis}")
        count = lambda c: F.size(F.filter(codes, lambda x: x == c))
        ranked = F.array_sort(F.transform(F.array_distinct(codes), lambda c, k: F.struct((-count(c)).alias("less"), k.alias("first"), c.alias("code"))))
        return F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: F.concat(spoken(x["code"]), F.lit(" ("), (-x["less"]).cast("string"), F.lit(")"))), ", ")

    risky = F.array_join(F.transform(F.filter(e, lambda x: x["outcome_claim"].isin(*V.RISKY_CLAIMS)), lambda x: x["episode_id"]), ", ")
    caveat = F.when(risky != "", F.concat(F.lit("Watch "), risky, F.lit(": these episodes end with unresolved, unverifiable, or overconfident claims."))).otherwise(
        F.concat(F.lit("Outcome claims lean toward "), top("outcome_claim"), F.lit("."))
    )
    style = lambda name, axis: F.concat(F.lit(f"Main {name} pattern: "), top(axis), F.lit("."))
    return {"difficulty_style": style("difficulty", "difficulty_type"), "detour_style": style("detour", "detour_type"), "recovery_style": style("recovery", "recovery_pattern"), "risk_or_caveat": caveat}


def patterns(episodes: DataFrame) -> DataFrame:
    """trace_id and the four styles, for traces with episodes: one group-by on the exchange that made the episodes."""
    return by_trace(episodes).select("trace_id", *[c.alias(name) for name, c in styles().items()])


def rated(e: str = "e") -> Column:
    """(tone, honesty, headline) of the episodes in column `e`, one at least: the gravest tone, the least honest claim."""
    grave = F.array_max(F.transform(f"{e}.recovery_pattern", lambda r: F.struct(lookup(V.SEVERITY, lookup(V.VIEW_TONES, r, "unknown"), 0).alias("severity"), lookup(V.VIEW_TONES, r, "unknown").alias("tone"))))
    claims = F.col(f"{e}.outcome_claim")
    honesty = F.when(F.array_contains(claims, "premature_success_claim"), "overclaimed").when(F.arrays_overlap(claims, F.array(*map(F.lit, V.CANDID_CLAIMS))), "candid").otherwise("mixed")
    headline = F.when(F.array_contains(claims, "premature_success_claim"), V.OVERCLAIMED_HEADLINE).otherwise(lookup(V.HEADLINES, grave["tone"], "A session across mixed terrain."))
    return F.struct(grave["tone"].alias("tone"), honesty.alias("honesty"), headline.alias("headline"))


def verdict(episodes: DataFrame) -> DataFrame:
    """trace_id, n_episodes, tone, honesty, headline for traces with episodes."""
    return by_trace(episodes).select("trace_id", F.size("e").cast("long").alias("n_episodes"), rated().alias("v")).select("trace_id", "n_episodes", "v.*")


def verdict_detail(n: Column, recovery_style: Column, caveat: Column) -> Column:
    return F.concat_ws(" ", F.concat(n.cast("string"), F.when(n == 1, " difficulty episode.").otherwise(" difficulty episodes.")), F.nullif(recovery_style, F.lit("")), F.nullif(caveat, F.lit("")))


def difficulty_clusters(episodes: DataFrame) -> DataFrame:
    """trace_id, difficulty_type, n, episode_ids (array, in order), example (the first episode's quote that there is; null if none)."""
    quote = F.min_by(F.get("evidence_quotes", F.lit(0)), F.when(F.size("evidence_quotes") > 0, F.col("episode_no")))
    return episodes.groupBy("trace_id", "difficulty_type").agg(F.count("*").alias("n"), in_order(F.col("episode_id")).alias("episode_ids"), quote.alias("example"))


def detour_groups(episodes: DataFrame) -> DataFrame:
    """trace_id, productive, mixed, unproductive: episode ids in order (arrays)."""
    held = lambda value: in_order(F.col("episode_id"), F.col("productive_detour") == value)
    return episodes.groupBy("trace_id").agg(held("yes").alias("productive"), held("mixed").alias("mixed"), held("no").alias("unproductive"))


def selection(e: str = "e", verdict: str = "verdict") -> dict[str, Column]:
    """The episode that a view opens with, the first grave one of a grave session, and the one it settles on, the first; '' without episodes."""
    first = F.get(e, F.lit(0))["episode_id"]
    grave = F.get(F.filter(e, lambda x: lookup(V.VIEW_TONES, x["recovery_pattern"], "unknown") == "risk"), 0)["episode_id"]
    return {"first_selected": F.coalesce(F.when(F.col(f"{verdict}.tone") == "risk", grave), first, F.lit("")), "selected": F.coalesce(first, F.lit(""))}


def window(e: str = "e") -> dict[str, Column]:
    """captured, duration_total of the episodes in column `e`, one at least: from the first one's start to the last one's end."""
    first, last = F.get(e, F.lit(0)), F.get(e, F.size(e) - 1)
    start, end = first["start_time"], last["end_time"]
    a, b = wall(start), wall(end)
    day, clock = lambda w: F.substring(w, 1, 10), lambda w: F.substring(w, 12, 5)
    both = instant(start).isNotNull() & instant(end).isNotNull()
    captured = (
        F.when(both & (day(a) == day(b)), F.concat(day(a), F.lit(" · "), clock(a), F.lit("–"), clock(b), F.lit(" UTC")))
        .when(both, F.concat(day(a), F.lit(" "), clock(a), F.lit(" → "), day(b), F.lit(" "), clock(b), F.lit(" UTC")))
        .when(a.isNotNull(), F.concat(day(a), F.lit(" · "), clock(a), F.lit(" UTC")))
        .otherwise(F.coalesce(F.nullif(start, F.lit("")), F.lit("—")))
    )
    whole = duration_label(start, end)
    return {"captured": captured, "duration_total": F.when(whole != "unknown", whole).otherwise(F.coalesce(F.nullif(last["duration_label"], F.lit("")), F.lit("—")))}


def capture_window(episodes: DataFrame) -> DataFrame:
    """trace_id, captured, duration_total for traces with episodes."""
    ends = by_trace(episodes.select("trace_id", "episode_no", "start_time", "end_time", "duration_label"))
    return ends.select("trace_id", *[c.alias(name) for name, c in window().items()])


def codebook(spark) -> DataFrame:
    """(axis, code, ordinal, meaning), a table of fixed size."""
    rows = [(axis, code, k, meaning) for axis, codes in V.CODEBOOK.items() for k, (code, meaning) in enumerate(codes.items())]
    one = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("axis", "code", "ordinal", "meaning"), strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(one))
