"""What a front end shows of episodes: labels, the audit of claims, ranked clusters, the trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.functions.text import spoken
from tracewright.operators.summary import difficulty_clusters, lookup


def label(code: Column) -> Column:
    """A code in words with a capital, or the label that stands for it."""
    words = spoken(code)
    special = F.create_map(*[F.lit(x) for pair in V.LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(special, code), F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000)))


def outcome_audit(episodes: DataFrame) -> DataFrame:
    """trace_id, episode_id, claim, tone, note, quote (the last one; null without any)."""
    tones, notes = ({c: v[k] for c, v in V.CLAIM_NOTES.items()} for k in (0, 1))
    claim = F.col("outcome_claim")
    quote = F.get("evidence_quotes", F.size("evidence_quotes") - 1)
    return episodes.select("trace_id", "episode_id", label(claim).alias("claim"), lookup(tones, claim, tones["unknown"]).alias("tone"), lookup(notes, claim, notes["unknown"]).alias("note"), quote.alias("quote"))


def ranked_clusters(episodes: DataFrame) -> DataFrame:
    """Difficulty clusters with their place in the trace: the largest first, equal ones by first appearance."""
    order = Window.partitionBy("trace_id").orderBy(F.col("n").desc(), F.get("episode_ids", F.lit(0)))
    return difficulty_clusters(episodes).select("trace_id", F.row_number().over(order).alias("place"), label(F.col("difficulty_type")).alias("label"), "n", F.array_join("episode_ids", ", ").alias("episode_ids"))


def trail(episodes: DataFrame) -> DataFrame:
    """trace_id, episode_id, tone, x, y: episodes spread evenly from left to right, height by tone with a slight zigzag."""
    whole = Window.partitionBy("trace_id")
    rank, n = F.row_number().over(whole.orderBy("episode_no")) - 1, F.count("*").over(whole)
    tone = lookup(V.VIEW_TONES, F.col("recovery_pattern"), "unknown")
    placed = episodes.select("trace_id", "episode_id", tone.alias("tone"), rank.alias("i"), n.alias("n"))
    x = V.FRAME["left"] + F.when(F.col("n") == 1, V.FRAME["width"] / 2).otherwise(F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) * V.FRAME["width"])
    height = F.least(F.lit(0.97), F.greatest(F.lit(0.06), lookup(V.ELEVATION, F.col("tone"), 0.3) + ((F.col("i") % 2) * 2 - 1) * 0.015))
    return placed.select("trace_id", "episode_id", "tone", F.round(x, 4).alias("x"), F.round(V.FRAME["base"] - height * V.FRAME["height"], 4).alias("y"))


def seconds_label(seconds: Column) -> Column:
    """'12s' or '3m 4s'; a dash for none."""
    text = lambda c: c.cast("long").cast("string")
    minutes, rest = F.floor(seconds / 60), F.floor(seconds % 60 + 0.5)
    return F.when(seconds.isNull() | F.isnan(seconds), "—").when(minutes > 0, F.concat(text(minutes), F.lit("m "), text(rest), F.lit("s"))).otherwise(F.concat(text(rest), F.lit("s")))
