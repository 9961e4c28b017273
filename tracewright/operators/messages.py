"""Roles, normalised text and dense indexes of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import AGENT_NAMES, ASSISTANT_ROLES, USER_ROLES
from tracewright.functions.text import clean_lines


#: Messages of a task that sorts them, on average at most.
TASK_ROWS = 100_000


def dealt(messages: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """So many rows dealt out by keys to tasks of TASK_ROWS, where the session's shuffle partitions would be larger: what a task sorts then does not grow with the input."""
    n = -(-(rows or 0) // TASK_ROWS)
    return messages.repartition(n, *keys) if n > int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")) else messages


def role_of(raw: Column) -> Column:
    """'assistant', 'user', or null for any other role."""
    low = F.lower(raw)
    return F.when(low.isin(*ASSISTANT_ROLES), "assistant").when(low.isin(*USER_ROLES), "user")


def settle(candidates: DataFrame, order: list[str], include_user: bool = True) -> DataFrame:
    """Messages from candidates (trace_id, role or null, text, timestamp, source and the columns of `order`): a role by default,
    text cleaned, empty ones dropped, users' kept on demand, numbered from 0 in each trace."""
    kept = candidates.withColumns({"role": F.coalesce("role", F.lit("assistant")), "text": clean_lines(F.col("text"))}).where(F.col("text") != "")
    kept = kept if include_user else kept.where("role = 'assistant'")
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)) - 1
    return kept.withColumn("msg_index", place.cast("long")).select("trace_id", "msg_index", "role", "text", "timestamp", "source")


def narrative(messages: DataFrame) -> DataFrame:
    """trace_id, narrative: every message under a numbered head, in order."""
    stamp = F.when(F.coalesce(F.col("timestamp"), F.lit("")) != "", F.concat(F.lit(" ["), "timestamp", F.lit("]"))).otherwise("")
    block = F.concat(F.format_string("## %04d %s", F.col("msg_index"), F.col("role")), stamp, F.lit("\n\n"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("msg_index", block.alias("block")))), lambda x: x["block"])
    return messages.groupBy("trace_id").agg(ordered.alias("blocks")).select("trace_id", F.concat(F.regexp_replace(F.array_join("blocks", "\n\n"), r"(?U)\A\s+|\s+\z", ""), F.lit("\n")).alias("narrative"))


def sampled(messages: DataFrame, budget: int = 16000, each: int = 320, rows: int | None = None) -> DataFrame:
    """The messages a model is shown: all, or where a trace has more than budget / each, that many evenly spaced ones with the first and last; text collapsed and cut, with its line.
    rows: their number, where it is known (see `dealt`)."""
    most = max(1, budget // each)
    n = messages.groupBy("trace_id").agg(F.count("*").alias("n"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n") / F.lit(float(most)))).cast("long"))
    picks = F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("n") - 1), spaced))
    wanted = n.select(F.col("trace_id").alias("pick_trace"), F.explode(F.when(F.col("n") <= most, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(picks)).alias("pick"))
    chosen = dealt(messages, rows, "trace_id", "msg_index").join(wanted, (F.col("trace_id") == F.col("pick_trace")) & (F.col("msg_index") == F.col("pick")), "left_semi")
    snippet = F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, each)
    line = F.concat(F.lit("["), F.col("msg_index").cast("string"), F.lit("] "), "role", F.lit(" "), F.coalesce("timestamp", F.lit("")), F.lit(": "), snippet)
    return chosen.select("trace_id", "msg_index", line.alias("line"))


def trace_title(agent: Column, stem: Column, original: Column | None = None) -> Column:
    """'<agent> trace: <stem>', or '<agent> · <original name>' where a log was handed over under a name of its own."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in AGENT_NAMES.items() for x in p]), agent), F.lit("Agent"))
    plain = F.concat(name, F.lit(" trace: "), stem)
    return plain if original is None else F.when(F.coalesce(original, F.lit("")) != "", F.concat(name, F.lit(" · "), original)).otherwise(plain)
