"""Answers of a language model: prompt, lenient reading, and taking them over where they are sound."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.functions.times import duration_label
from tracewright.operators.episodes import COLUMNS, episode_id
from tracewright.operators.devices import on_device
from tracewright.operators.messages import dealt

FIELDS = (
    "title", "initial_intention", "reported_difficulty", "difficulty_type", "appraisal", "strategy_before", "strategy_after", "detour_type", "resolution_mode", "recovery_pattern",
    "outcome_claim", "productive_detour", "analyst_memo",
)
ANSWER = (
    "struct<error:string,verdict:struct<tone:string,headline:string,detail:string,honesty:string>,patterns:map<string,string>,"
    f"episodes:array<struct<start_index:bigint,end_index:bigint,{','.join(f + ':string' for f in FIELDS)},evidence_quotes:array<string>>>>"
)
#: Schema placeholders that weak models echo (fixed value).
PLACEHOLDER = r"(?is)^\s*(<.*>|<=.*|\d+(\s*-\s*\d+)?\s+sentences?.*|one key.*|short verbatim.*|up to \d+.*|a message index.*)\s*$"
MOST_PROMPT = 16000


def _objects(text: str) -> Iterator[dict]:
    """Top-level JSON objects anywhere in a text."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            if isinstance(value, dict):
                yield value
        at = text.find("{", end)


def read_answer(content: str | None) -> dict:
    """The report in a model's answer: bare, fenced, or the last object in prose. Raises ValueError if there is none with a list of episodes."""
    if not isinstance(content, str) or not content.strip():
        raise ValueError(V.ANSWER_ERRORS["empty"])
    text = re.sub(r"\A```[a-zA-Z0-9]*\s*(.*?)\s*```\Z", r"\1", content.strip(), flags=re.DOTALL).strip()
    try:
        found = json.loads(text)
    except ValueError:
        found = None
        for found in _objects(text):  # noqa: B007  the last one counts
            pass
        if found is None:
            raise ValueError(V.ANSWER_ERRORS["json"]) from None
    if not isinstance(found, dict):
        raise ValueError(V.ANSWER_ERRORS["object"])
    if not isinstance(found.get("episodes"), list):
        raise ValueError(V.ANSWER_ERRORS["episodes"])
    return found


def _whole(value: object) -> int:
    try:
        return max(-(2**62), min(int(value), 2**62))
    except (TypeError, ValueError, OverflowError):
        return 0


def _told(value: object) -> str:
    return str(value or "").strip()


def _typed(found: dict) -> dict:
    episodes = []
    for e in found["episodes"]:
        if isinstance(e, dict):
            start = e.get("start_index", 0)
            quotes = e.get("evidence_quotes") or []
            quotes = list(quotes) if isinstance(quotes, (str, list)) else []
            first = _whole(start)
            episodes.append({"start_index": first, "end_index": _whole(e["end_index"]) if "end_index" in e else first, **{f: _told(e.get(f)) for f in FIELDS}, "evidence_quotes": [_told(q) for q in quotes]})
    verdict = found.get("verdict") if isinstance(found.get("verdict"), dict) else {}
    patterns = found.get("overall_patterns") if isinstance(found.get("overall_patterns"), dict) else {}
    return {"error": None, "verdict": {k: _told(verdict.get(k)) for k in ("tone", "headline", "detail", "honesty")} if verdict else None, "patterns": {str(k): _told(v) for k, v in patterns.items()}, "episodes": episodes}


def parsed(answers: DataFrame) -> DataFrame:
    """trace_id, answer (ANSWER) from answers (trace_id, content, and error where a model failed); unsound ones have an error instead."""

    def parse(content: str | None, failure: str | None) -> dict:
        try:
            if failure is None:
                return _typed(read_answer(content))
        except ValueError as error:
            failure = f"ValueError: {str(error).strip().rstrip('.')}"
        return {"error": failure, "verdict": None, "patterns": {}, "episodes": []}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["trace_id"]].assign(answer=[parse(c, e) for c, e in zip(frame["content"], frame["error"], strict=True)])

    kind = answers.schema["trace_id"].dataType.simpleString()
    told = answers if "error" in answers.columns else answers.withColumn("error", F.lit(None).cast("string"))
    return told.select("trace_id", "content", "error").mapInPandas(run, f"trace_id {kind}, answer {ANSWER}")


def clean(text: Column) -> Column:
    """The text, or '' where it echoes a placeholder or is missing."""
    return F.when(F.coalesce(F.trim(text), F.lit("")).rlike(PLACEHOLDER), "").otherwise(F.coalesce(F.trim(text), F.lit("")))


def coded(text: Column, axis: str) -> Column:
    return F.when(text.isin(*V.CODEBOOK[axis]), text).otherwise("unknown")


def model_episodes(answers: DataFrame, messages: DataFrame, n_messages: int | None = None) -> DataFrame:
    """Episodes (COLUMNS) of sound answers: indexes held within the trace and put in order, codes outside the codebook unknown, echoes dropped, times from the messages."""
    last = messages.groupBy("trace_id").agg(F.max("msg_index").alias("last"))
    rows = answers.where("answer.error IS NULL").join(last, "trace_id").select("trace_id", "last", F.posexplode("answer.episodes").alias("k", "e"))
    held = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col(c), F.col("last")))
    spans = rows.withColumns({"x": held("e.start_index"), "y": held("e.end_index")}).withColumns({"start_index": F.least("x", "y"), "end_index": F.greatest("x", "y")})
    times = dealt(messages.select(F.col("trace_id").alias("t"), F.col("msg_index").alias("i"), "timestamp"), n_messages, "t", "i")
    for side in ("start", "end"):
        at = times.withColumnRenamed("timestamp", f"{side}_time")
        spans = spans.join(at, (F.col("trace_id") == F.col("t")) & (F.col(f"{side}_index") == F.col("i")), "left").drop("t", "i")
    e = lambda f: F.col(f"e.{f}")
    told = clean(e("reported_difficulty"))
    title = F.when(clean(e("title")) != "", clean(e("title"))).when(told != "", F.substring(told, 1, 60)).otherwise("Difficulty episode")
    productive = F.lower(e("productive_detour"))
    codes = {axis: coded(e(axis), axis) for axis in V.CODEBOOK}
    texts = {f: clean(e(f)) for f in ("initial_intention", "strategy_before", "strategy_after", "analyst_memo")}
    quotes = F.slice(F.filter(F.transform(e("evidence_quotes"), clean), lambda q: q != ""), 1, 3)
    number = (F.col("k") + 1).cast("long")
    return spans.withColumns({
        "episode_no": number, "episode_id": episode_id(number), "title": title, "reported_difficulty": told, "duration_label": duration_label(F.col("start_time"), F.col("end_time")),
        "productive_detour": F.when(productive.isin(*V.PRODUCTIVE), productive).otherwise("unknown"), "evidence_quotes": quotes, **codes, **texts,
    }).select(*COLUMNS)


def model_verdict(answers: DataFrame) -> DataFrame:
    """trace_id, tone, headline, detail, honesty of sound answers that give a verdict."""
    v = lambda f: F.col(f"answer.verdict.{f}")
    tone, honesty = F.lower(v("tone")), F.lower(v("honesty"))
    headline = F.when(clean(v("headline")) != "", clean(v("headline"))).otherwise(V.MODEL_HEADLINE)
    return answers.where("answer.error IS NULL AND answer.verdict IS NOT NULL").select(
        "trace_id", F.when(tone.isin(*V.SEVERITY), tone).otherwise("unknown").alias("tone"), headline.alias("headline"), clean(v("detail")).alias("detail"),
        F.when(honesty.isin(*V.HONESTY), honesty).otherwise("mixed").alias("honesty"),
    )


def take_over(own: DataFrame, answers: DataFrame, messages: DataFrame, rows: int | None = None) -> DataFrame:
    """Episodes of each trace: the model's where its answer is sound, else the rules' own."""
    sound = answers.where("answer.error IS NULL").select("trace_id")
    return own.join(sound, "trace_id", "left_anti").unionByName(model_episodes(answers, messages, rows))


def prompts(lines: DataFrame, episodes: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """trace_id, prompt: the kind of agent (of agents: trace_id, agent; 'unknown' without), the codebook, a hint of the rules' first twelve episodes, and the sampled narrative up to MOST_PROMPT characters."""
    vocabulary = "\n\n".join(f"{axis}:\n" + "\n".join(f"- {c}: {m}" for c, m in codes.items()) for axis, codes in V.CODEBOOK.items())
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_index", "line"))), lambda x: x["line"]), "\n")
    narrative = lines.groupBy("trace_id").agg(F.substring(told, 1, MOST_PROMPT).alias("narrative"))
    spot = F.concat("episode_id", F.lit(" msgs "), F.col("start_index").cast("string"), F.lit("-"), F.col("end_index").cast("string"))
    hint = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("episode_no", spot.alias("spot")))), lambda x: x["spot"]), 1, 12), "; ")
    hints = episodes.groupBy("trace_id").agg(hint.alias("hint"))
    ask = F.lit("Write a JSON object with verdict, overall_patterns and episodes for this session. Use only these codes.\n\n" + vocabulary + "\n\nAgent type: ")
    told = narrative.join(hints, "trace_id", "left")
    told = told.join(agents.select("trace_id", "agent"), "trace_id", "left") if agents is not None else told.withColumn("agent", F.lit(None).cast("string"))
    agent = F.coalesce("agent", F.lit("unknown"))
    return told.select("trace_id", F.concat(ask, agent, F.lit("\n\nLikely episodes: "), F.coalesce("hint", F.lit("(none)")), F.lit("\n\nNarrative:\n"), "narrative").alias("prompt"))


def generate(asked: DataFrame, model: Callable[[str], str], profile: ResourceProfile | None = None) -> DataFrame:
    """trace_id, content, error: answers of an injected model, called in the tasks; a call that fails gives its error's name and text instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for prompt in frame["prompt"]:
                try:
                    answers.append(model(prompt))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  a failing model leaves the rules' result standing
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {str(error).strip().rstrip('.')}")
            yield frame[["trace_id"]].assign(content=answers, error=errors)

    kind = asked.schema["trace_id"].dataType.simpleString()
    return on_device(asked.select("trace_id", "prompt"), run, f"trace_id {kind}, content string, error string", profile)


def engine_notes(engine: str, answers: DataFrame | None) -> DataFrame | Column:
    """For a known engine, trace_id, engine (the model's name, where its answer is sound) and model_notes; for an unknown one, the note."""
    if answers is None:
        return F.array(F.lit(V.MODEL_NOTES["unknown"] % engine))
    sound, name = F.col("answer.error").isNull(), V.MODELS[engine]
    note = F.when(sound, F.lit(V.MODEL_NOTES["produced"] % name)).otherwise(F.format_string(V.MODEL_NOTES["unavailable"], F.col("answer.error")))
    return answers.select("trace_id", F.when(sound, name).alias("engine"), F.array(note).alias("model_notes"))
