"""Session logs in files: JSON documents, JSON lines or plain transcripts, many at a time.

Files are read whole (a log is one session and fits a task). Two small Arrow functions do what built-ins cannot: Python's reading of JSON
(duplicate keys, NaN, trailing text, any depth) and the walk through nested content. All else is built-in. A file that cannot be
read gives a row with an error and does not fail the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.operators.messages import settle

#: Where Python's splitlines breaks: also at separators that text files rarely have.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: So many of a log's records tell its agent.
SNIFFED = 20
FOUND = "array<struct<raw_index:int,timestamp:string,ordinal:int,role:string,text:string,source:string>>"
CANDIDATES = "array<struct<ordinal:int,role:string,text:string,source:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, content: files of a folder or pattern; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def with_format(files: DataFrame) -> DataFrame:
    """files (trace_id, path, content) with suffix, and error for blank ones."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.withColumns({"suffix": suffix, "error": F.when(~F.col("content").rlike(r"(?U)\S"), V.EMPTY_TRACE)})


def _document(value: object) -> list:
    """The records of a JSON document: a list, the first list under a known key, or the value itself."""
    if isinstance(value, dict):
        return next((value[k] for k in V.LIST_KEYS if isinstance(value.get(k), list)), [value])
    return value if isinstance(value, list) else [str(value)]


def _records(content: str, suffix: str) -> tuple[list | None, str | None]:
    """(records, error). None without an error means a plain transcript."""
    if suffix == ".json":
        try:
            return _document(json.loads(content)), None
        except ValueError as error:
            return None, f"The JSON trace could not be parsed: {error}"
    records = []
    for line in filter(str.strip, content.splitlines()):
        try:
            records.append(json.loads(line))
        except ValueError:
            if not records:
                return None, None
            records.append(line)
    return records, None


def parsed(files: DataFrame, skip_tools: bool = True, heads: int | None = SNIFFED) -> DataFrame:
    """trace_id, content (of plain transcripts alone), heads (the first records, as JSON; all where `heads` is None), found (what all records say), error.

    Each file is read once: messages_of, heads_of and errors_of take what they need from here.
    """
    formatted = with_format(files)

    def said(k: int, record: object) -> list[dict]:
        candidates, time = _candidates(record, skip_tools)
        return [{"raw_index": k, "timestamp": time, **c} for c in candidates]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [(None, e) if e else _records(c or "", s) for c, s, e in zip(frame["content"], frame["suffix"], frame["error"], strict=True)]
            plain = [c if r is None and e is None else None for c, (r, e) in zip(frame["content"], both, strict=True)]
            first = [None if r is None else [json.dumps(x) for x in r[:heads]] for r, _ in both]
            found = [None if r is None else [c for k, x in enumerate(r) for c in said(k, x)] for r, _ in both]
            yield frame[["trace_id"]].assign(content=plain, heads=first, found=found, error=[e for _, e in both])

    kind = files.schema["trace_id"].dataType.simpleString()
    return formatted.select("trace_id", "content", "suffix", "error").mapInPandas(parse, f"trace_id {kind}, content string, heads array<string>, found {FOUND}, error string")


def _transcripts(read: DataFrame) -> DataFrame:
    return plain_blocks(read.where("heads IS NULL AND error IS NULL").select("trace_id", "content"))


def heads_of(read: DataFrame) -> DataFrame:
    """trace_id, raw_index, record (JSON) for the records that `parsed` kept; plain transcripts give one for each block of a speaker."""
    structured = read.where("heads IS NOT NULL").select("trace_id", F.posexplode("heads").alias("raw_index", "record"))
    blocks = _transcripts(read).select("trace_id", F.col("block").cast("int").alias("raw_index"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("record"))
    return structured.unionByName(blocks)


def messages_of(read: DataFrame, include_user: bool = True) -> DataFrame:
    """(trace_id, msg_index, role, text, timestamp, source) from what `parsed` found."""
    structured = read.where("heads IS NOT NULL").select("trace_id", F.inline("found"))
    blocks = _transcripts(read).select(
        "trace_id", F.col("block").cast("int").alias("raw_index"), F.lit(None).cast("string").alias("timestamp"), F.lit(0).alias("ordinal"), "role", "text", F.lit("content").alias("source"),
    )
    return settle(structured.unionByName(blocks), ["raw_index", "ordinal"], include_user)


def errors_of(read: DataFrame) -> DataFrame:
    """trace_id, error for files that give no records."""
    return read.where("error IS NOT NULL").select("trace_id", "error")


def records(files: DataFrame) -> DataFrame:
    """trace_id, raw_index, record (JSON) for every record, for those who store records; messages takes them up again."""
    return heads_of(parsed(files, heads=None))


def errors(files: DataFrame) -> DataFrame:
    return errors_of(parsed(files))


def plain_blocks(files: DataFrame) -> DataFrame:
    """trace_id, block (from 0), role, text of transcripts (trace_id, content): a line that starts with a speaker opens a block; before any, the agent speaks."""
    return blocks_of(files.select("trace_id", F.posexplode(F.split("content", LINE_BREAK)).alias("at", "line")).withColumn("k", F.lit(0)))


def blocks_of(lines: DataFrame) -> DataFrame:
    """plain_blocks of the lines (trace_id, at, k, line) of transcripts, which stand in the order of at and k."""
    bare = F.regexp_replace("line", r"(?U)\A\s+|\s+\z", "")
    speaker = F.lower(F.regexp_extract(bare, r"(?i)\A(assistant|agent|user):", 1))
    order = Window.partitionBy("trace_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"speaker": speaker, "said": F.when(speaker != "", F.regexp_replace(bare, r"\A[^:]*:(?U:\s*)", "")).otherwise(F.col("line"))})
    numbered = marked.withColumn("raw_block", F.sum((F.col("speaker") != "").cast("int")).over(order))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "said"))), lambda x: x["said"]), "\n")
    role = F.when(F.max("speaker") == "user", "user").otherwise("assistant")
    blocks = numbered.groupBy("trace_id", "raw_block").agg(role.alias("role"), F.regexp_replace(said, r"(?U)\A\s+|\s+\z", "").alias("text")).where(F.col("text") != "")
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("raw_block")) - 1
    return blocks.select("trace_id", place.cast("long").alias("block"), "role", "text")


# --- one record


def _toolish(item: dict) -> bool:
    named = [str(item.get(k, "")).lower() for k in ("type", "name")]
    return str(item.get("role", "")).lower() == "tool" or any(f in n for f in V.TOOL_FRAGMENTS for n in named) or any(k in item for k in V.TOOL_KEYS)


def _text(content: object, skip_tools: bool = True) -> str:
    """The visible prose of content of any shape."""
    match content:
        case None:
            return ""
        case str():
            return content
        case bool() | int() | float():
            return str(content)
        case list():
            return "\n\n".join(t for x in content if (t := _text(x, skip_tools)).strip())
        case dict() if skip_tools and _toolish(content):
            return ""
        case dict():
            named = (_text(content[k], skip_tools) for k in V.TEXT_KEYS if content.get(k) is not None)
            return next((t for t in named if t.strip()), None) or (_text(content["content"], skip_tools) if "content" in content else "")
    return ""


def _role(value: object) -> str | None:
    low = str(value or "").lower()
    return "assistant" if low in V.ASSISTANT_ROLES else "user" if low in V.USER_ROLES else None


def _time(record: dict) -> str | None:
    own = (record[k].strip() for k in V.TIME_KEYS if isinstance(record.get(k), str) and record[k].strip())
    inner = (_time(record[k]) for k in ("payload", "message", "snapshot") if isinstance(record.get(k), dict))
    return next(own, None) or next(filter(None, inner), None)


def _candidates(record: object, skip_tools: bool = True) -> tuple[list[dict], str | None]:
    """What a record says, each text once for its role, and when."""
    if not isinstance(record, dict):
        return [{"ordinal": 0, "role": "assistant", "text": record if isinstance(record, str) else str(record), "source": "plain_text"}], None
    found: list[tuple[str | None, object, str]] = []
    top = _role(record.get("role")) or _role(record.get("type"))
    payload, message = record.get("payload"), record.get("message")
    if isinstance(payload, dict):
        kind = str(payload.get("type", "")).lower()
        role = _role(payload.get("role")) or ("assistant" if kind.startswith("agent") else "user" if kind.startswith("user") else None)
        found += [(role, payload[k], f"payload.{k}") for k in ("content", "message", "summary", "text") if k in payload]
    if isinstance(message, dict):
        role = _role(message.get("role")) or _role(record.get("type"))
        found += [(role, message[k], f"message.{k}") for k in ("content", "text", "message") if k in message]
    elif message is not None:
        found.append((top, message, "message"))
    found += [(top, record[k], k) for k in ("content", "text", "summary", "body") if k in record]
    out: dict[tuple[str, str], dict] = {}
    for k, (role, content, source) in enumerate(found):
        if text := _text(content, skip_tools):
            out.setdefault((role or "assistant", text), {"ordinal": k, "role": role or "assistant", "text": text, "source": source})
    return list(out.values()), _time(record)


def messages(parsed: DataFrame, include_user: bool = True, skip_tools: bool = True) -> DataFrame:
    """(trace_id, msg_index, role, text, timestamp, source) from records (trace_id, raw_index, record)."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [_candidates(json.loads(r), skip_tools) for r in frame["record"]]
            yield frame[["trace_id", "raw_index"]].assign(found=[c for c, _ in both], timestamp=[t for _, t in both])

    kind = parsed.schema["trace_id"].dataType.simpleString()
    found = parsed.select("trace_id", "raw_index", "record").mapInPandas(extract, f"trace_id {kind}, raw_index int, found {CANDIDATES}, timestamp string")
    rows = found.select("trace_id", "raw_index", "timestamp", F.inline("found"))
    return settle(rows, ["raw_index", "ordinal"], include_user)


def agents(parsed: DataFrame, files: DataFrame, first: int = SNIFFED) -> DataFrame:
    """trace_id, agent: by the path, else by the first of the first records that tells, else 'unknown'."""
    p = F.lower("path")
    by_path = F.when(p.contains(".codex") | p.contains("/codex/"), "codex").when(p.contains("claude"), "claude_code").when(p.contains(".pi") | p.contains("/pi/"), "pi")
    told = parsed.where(F.col("raw_index") < first).select("trace_id", "raw_index", record_agent(F.col("record")).alias("agent")).where("agent IS NOT NULL")
    by_record = told.groupBy("trace_id").agg(F.min_by("agent", "raw_index").alias("agent"))
    return files.select("trace_id", by_path.alias("by_path")).join(by_record, "trace_id", "left").select("trace_id", F.coalesce("by_path", "agent", F.lit("unknown")).alias("agent"))


def record_agent(record: Column) -> Column:
    """The agent that a record (a JSON text as Python writes it) tells of, or null."""
    v = F.try_parse_json(record)
    at = lambda path: F.try_variant_get(v, path, "string")
    kind = F.lower(F.coalesce(at("$.type"), F.lit("")))
    keys = F.map_keys(F.from_json(record, "map<string,string>"))  # of the record itself, whatever their values
    has = lambda *names: F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))
    payload_kind = F.coalesce(at("$.payload.type"), F.lit(""))
    return F.when(record.startswith("{"), (
        F.when(kind.isin("session_meta", "turn_context", "response_item", "event_msg"), "codex")
        .when((at("$.payload.originator") == "codex_cli") | payload_kind.startswith("agent_") | payload_kind.startswith("user_"), "codex")
        .when(has("parentUuid", "sessionId", "userType"), "claude_code")
        .when(F.lower(F.coalesce(at("$.message.model"), F.lit(""))).contains("claude"), "claude_code")
        .when(kind.startswith("pi_") | F.substring(F.lower(record), 1, 1000).contains("pi agent"), "pi")
    ))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), re.escape(".") + r"[^.]*$", "")
