"""Redaction of secrets by patterns, and of personal data by spans that a detector gives."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import PERSONAL, REDACTION_CLUES, REDACTIONS
from tracewright.functions.text import spaced
from tracewright.operators.devices import on_device

SPANS = "array<struct<start:int,end:int,label:string>>"


#: Patterns of the rules without clues, which are clues themselves.
CLUELESS = [spaced(pattern) for (_, pattern, _), clues in zip(REDACTIONS, REDACTION_CLUES, strict=True) if not clues]


def java_replacement(replacement: str) -> str:
    """`\\1` as Java's `$1`; a doubled backslash stays one."""
    return replacement.replace("\\1", "$1")


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """df with `column` redacted, redactions (map of label to count, without zeros) and redaction_count.

    The rules run in order, each on what the one before left, and each is counted on what it rewrites; a rule is tried where one of
    its clues stands, and its matches are counted and replaced where there is one. A null text stays null with count 0.
    """
    labels = F.array(*[F.lit(label) for label, _, _ in REDACTIONS])
    none = F.struct(F.col(column).alias("text"), F.array().cast("array<bigint>").alias("counts"))
    # most texts have no clue at all, which is told outside of the rules' nested steps, by compiled code; no rule writes what is a clue to a later one
    clued = functools.reduce(Column.__or__, [F.col("__low").contains(c) for clues in REDACTION_CLUES for c in clues] + [F.rlike(column, F.lit(p)) for p in CLUELESS])
    told = F.when(clued, _all_rules(F.col(column), F.col("__low"))).when(F.col(column).isNotNull(), none)
    done = df.withColumn("__low", F.lower(column)).withColumn("__done", told).drop("__low")
    counts = F.col("__done.counts")
    pairs = F.filter(F.zip_with(labels, counts, lambda label, n: F.struct(label.alias("key"), n.alias("value"))), lambda p: p["value"] > 0)
    found = F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,bigint>"))
    total = F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda n, c: n + c), F.lit(0))
    return done.withColumns({column: F.col("__done.text"), "redactions": found, "redaction_count": total}).drop("__done")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out and written once however often it is used; a filter that Spark pushes below stays as short."""
    return F.get(F.transform(F.array(value), use), 0)


def _all_rules(text: Column, low: Column) -> Column:
    """The text after all rules and the counts of each, as a struct; null for a null text."""
    state = F.struct(text.alias("text"), F.array().cast("array<bigint>").alias("counts"))
    for (_, pattern, replacement), clues in zip(REDACTIONS, REDACTION_CLUES, strict=True):
        state = _bound(state, _one_rule(low, spaced(pattern), java_replacement(replacement), clues))
    return F.when(text.isNotNull(), state)


def _one_rule(low: Column, pattern: str, replacement: str, clues: tuple[str, ...]) -> Callable[[Column], Column]:
    may = functools.reduce(Column.__or__, [low.contains(c) for c in clues], F.lit(not clues))

    def after(s: Column) -> Column:
        said = lambda text, n: F.struct(text.alias("text"), F.concat(s["counts"], F.array(n.cast("long"))).alias("counts"))
        hit = may & F.rlike(s["text"], F.lit(pattern))
        return F.when(hit, said(F.regexp_replace(s["text"], pattern, replacement), F.regexp_count(s["text"], F.lit(pattern)))).otherwise(said(s["text"], F.lit(0)))

    return after


def totals(redacted: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, n): how often each rule rewrote something."""
    # outer: Spark would push the filter of an inner one below the redaction and redact twice
    return redacted.select(*keys, F.explode_outer("redactions").alias("label", "n")).where("label IS NOT NULL").groupBy(*keys, "label").agg(F.sum("n").alias("n"))


def merge_spans(spans: Column, length: Column, joined: bool = True) -> Column:
    """Disjoint spans in order: malformed ones and unknown labels dropped, runs of one label joined across a gap of one, other overlaps clipped.
    Without `joined`, for detectors whose spans are whole entities and not pieces of them, spans of one label stay apart."""
    known = F.filter(spans, lambda s: s["label"].isin(*PERSONAL) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= length))
    none = F.array().cast(SPANS)

    def add(kept: Column, span: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        joins = F.lit(joined) & (F.size(kept) > 0) & (last["label"] == span["label"]) & (span["start"] <= last["end"] + 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), last["label"].alias("label"))
        start = F.greatest(span["start"], F.coalesce(last["end"], F.lit(0)))
        clipped = F.struct(start.alias("start"), span["end"].alias("end"), span["label"].alias("label"))
        extended = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(longer))
        return F.when(joins, extended).when(start < span["end"], F.concat(kept, F.array(clipped))).otherwise(kept).cast(SPANS)

    return F.aggregate(F.array_sort(known), none, add)


def mask(text: Column, spans: Column) -> Column:
    """The text with each of these disjoint, ordered spans replaced by its label's placeholder."""
    placeholder = F.create_map(*[F.lit(x) for label, (p, _) in PERSONAL.items() for x in (label, p)])
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.try_element_at(placeholder, s["label"])).alias("out"), s["end"].alias("at")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def pii_counts(spans: Column) -> Column:
    """Map of note name to number of spans, from disjoint spans."""
    name = F.create_map(*[F.lit(x) for label, (_, n) in PERSONAL.items() for x in (label, n)])
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.try_element_at(name, s["label"]))))
    return F.map_from_arrays(labels, F.transform(labels, lambda n: F.size(F.filter(spans, lambda s: F.try_element_at(name, s["label"]) == n)).cast("long")))


def redact_personal(df: DataFrame, spans: Column, column: str = "text", joined: bool = True) -> DataFrame:
    """df with personal data masked in `column`, pii (map of note name to count) and pii_count; where spans is null (a detector failed), nothing is. `joined` as of merge_spans."""
    merged = df.withColumn("__spans", merge_spans(F.coalesce(spans, F.array().cast(SPANS)), F.length(column), joined))
    return merged.withColumns({column: mask(F.col(column), F.col("__spans")), "pii": pii_counts(F.col("__spans")), "pii_count": F.size("__spans").cast("long")}).drop("__spans")


def added(a: Column, b: Column) -> Column:
    """Two maps of label to count as one; counts of a label that both have add up."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(a, k), F.lit(0)) + F.coalesce(F.try_element_at(b, k), F.lit(0))))


def two_passes(messages: DataFrame, detector: Callable[[list[str]], list[list[dict]]] | None = None, least: float = 0.5, profile: ResourceProfile | None = None, joined: bool = True) -> DataFrame:
    """messages with secrets redacted by patterns and then, where there is a detector, personal data by its spans; redactions and redaction_count
    count both. screened says that the detector ran on a row, detector_error why not; `joined` as of merge_spans."""
    first = redact(messages)
    if detector is None:
        return first.withColumns({"screened": F.lit(False), "detector_error": F.lit(None).cast("string")})
    second = redact_personal(detect(first, detector, least=least, profile=profile), F.col("spans"), joined=joined)
    both = {"redactions": added(F.col("redactions"), F.col("pii")), "redaction_count": F.col("redaction_count") + F.col("pii_count"), "screened": F.col("spans").isNotNull()}
    return second.withColumns(both).drop("spans", "pii", "pii_count")


def pattern_spans(text: Column, patterns: dict[str, str]) -> Column:
    """Spans of a detector made of patterns by label. A match is found by its text, so equal matches are located one after another."""
    pieces = [_located(text, pattern, label) for label, pattern in patterns.items()]
    return F.flatten(F.array(*pieces))


def _located(text: Column, pattern: str, label: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.array().cast(SPANS).alias("spans"), F.lit(0).alias("at"))

    def add(a: Column, m: Column) -> Column:
        at = a["at"] + F.call_function("locate", m, F.substring(text, a["at"] + 1, F.length(text))) - 1
        span = F.struct(at.alias("start"), (at + F.length(m)).alias("end"), F.lit(label).alias("label"))
        return F.struct(F.concat(a["spans"], F.array(span)).cast(SPANS).alias("spans"), (at + F.length(m)).alias("at"))

    return F.aggregate(found, start, add)["spans"]


def detect(df: DataFrame, detector: Callable[[list[str]], list[list[dict]]], column: str = "text", least: float = 0.5, profile: ResourceProfile | None = None) -> DataFrame:
    """df with spans from an injected detector, called on batches of texts in the tasks; blank texts have none, nor do spans of low score.

    A batch that fails is tried again trace by trace (trace_id, where df has it): a trace that fails again has null spans and the
    error's name in detector_error, is not tried any more by the task, and keeps its pattern redaction.
    """
    fields = [f for f in df.schema.fields if f.name not in ("spans", "detector_error")]
    keep = lambda spans: [{k: s[k] for k in ("start", "end", "label")} for s in spans if s.get("start") is not None and s.get("end") is not None and float(s.get("score", 1.0)) >= least]

    def found(texts: list[str]) -> list[list[dict]]:
        answers = iter(detector([t for t in texts if t.strip()]))
        return [keep(next(answers)) if t.strip() else [] for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed: dict[object, str] = {}
        for frame in frames:
            texts = frame[column].fillna("").tolist()
            traces = frame["trace_id"].tolist() if "trace_id" in frame else [None] * len(texts)
            spans: list = [None] * len(texts)
            groups = [[k for k, t in enumerate(traces) if t not in failed]]
            if groups[0]:
                try:
                    found_all = found([texts[k] for k in groups[0]])
                    groups = []
                    for k, s in zip([k for k, t in enumerate(traces) if t not in failed], found_all, strict=True):
                        spans[k] = s
                except Exception:  # noqa: BLE001  told apart below
                    groups = [[k for k in groups[0] if traces[k] == t] for t in dict.fromkeys(traces[k] for k in groups[0])]
            for rows in filter(None, groups):
                try:
                    for k, s in zip(rows, found([texts[k] for k in rows]), strict=True):
                        spans[k] = s
                except Exception as error:  # noqa: BLE001  any failure of a model leaves patterns alone
                    failed[traces[rows[0]]] = type(error).__name__
            # a trace that fails later in a task is not half screened in this batch
            yield frame.assign(spans=spans, detector_error=[failed.get(t) for t in traces])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return on_device(df.select(*[f.name for f in fields]), run, f"{columns}, spans {SPANS}, detector_error string", profile)
