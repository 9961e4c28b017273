"""Records of logs as VARIANT: what plain records say is told by built-in functions alone.

Lines and documents are parsed by try_parse_json, and a document's list of records is exploded as an array of VARIANT. A record goes to Python only if VARIANT refuses it or would read it
otherwise than Python does (keys that repeat, NaN, surrogates alone, huge numbers), or if its content is nested or typed so that the walk through it has no fixed depth.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed_values as V
from tracewright.operators.messages import role_of, settle
from tracewright.sources import logs, traces
from tracewright.sources.scratch import stored

FOUND = "array<struct<ordinal:int,role:string,text:string,source:string>>"
#: Stands after the value when it is parsed, so that text behind it is seen.
END = "\u0001end"
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: What JSON begins with, Python's own additions included.
BEGINS = r"\A\s*[\[{\"\-0-9tfnNI]"
#: Numbers that VARIANT rounds or calls by name, and surrogates without their other half, which no string can hold, with what they begin with.
ODD = r"[0-9](?:[0-9]{37}|[eE]\+?[0-9]{3})"
ALONE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"
SURROGATE = ("\\ud", "\\uD")
#: What objects are asked for: the record, what lies in it, and parts of content.
WITHIN = ("payload", "message", "snapshot")
INSIDE = ("role", "type", "content", "text", "summary", *WITHIN, *V.TIME_KEYS)
PART = ("role", "type", "name", V.TEXT_KEYS[0], *V.TOOL_KEYS)


def lines_of(files: DataFrame) -> DataFrame:
    """The lines of whole files (trace_id, path, content), as the source `session_logs` gives them; `at` counts lines, and form is 'odd' where only Python can tell whether the first line is JSON."""
    told = traces.with_format(files)
    first = F.regexp_extract("content", rf"(?U)\A(?:\s*(?:{traces.LINE_BREAK}))?([^{BREAKS}]*)", 1)
    form = (
        F.when(F.col("error").isNotNull(), logs.BLANK).when(F.col("suffix") == ".json", logs.DOCUMENT).when(~first.rlike(BEGINS), logs.TRANSCRIPT).when(value_of(first).isNotNull(), logs.JSON_LINES).otherwise("odd")
    )
    # one explosion for all forms: a filter on the form would have Spark work it out twice
    parts = F.when(F.col("form").isin(logs.JSON_LINES, logs.TRANSCRIPT), F.split("content", traces.LINE_BREAK)).otherwise(F.array(F.when(F.col("form") != logs.BLANK, F.col("content"))))
    lines = told.withColumn("form", form).select("trace_id", "form", F.posexplode(parts).alias("at", "line"))
    kept = (F.col("form") != logs.JSON_LINES) | F.col("line").rlike(r"(?U)\S")
    return lines.where(kept).select("trace_id", F.col("at").cast("long").alias("at"), F.lit(0).alias("k"), "form", "line")


def lines_at(spark: SparkSession, path: str, split: int | None = None, whole: bool | None = None) -> DataFrame:
    """The lines of all logs under a path: by the source `session_logs`, or, where only Spark reaches the store or `whole` is asked for, of whole files."""
    if not logs.reachable(path) if whole is None else whole:
        return lines_of(traces.read(spark, path).withColumn("trace_id", F.col("path")))
    return logs.scan(spark, path, split or logs.SPLIT)


def value_of(text: Column) -> Column:
    """The text as VARIANT if it is one JSON value and nothing else, and Python reads the same; else null."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{json.dumps(END)[1:-1]}"]'))), "$", "array<variant>")
    sound = lambda b: (F.size(b) == 2) & (F.try_variant_get(F.get(b, 1), "$", "string") == END)
    odd = text.rlike(ODD) | ((text.contains(SURROGATE[0]) | text.contains(SURROGATE[1])) & text.rlike(ALONE))
    return F.when(~odd, F.get(F.transform(F.array(both), lambda b: F.when(sound(b), F.get(b, 0))), 0))  # parsed once


def at(v: Column, *keys: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f".{k}" for k in keys), "variant")


def fields(v: Column) -> Column:
    """The fields of an object; null of anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(leaf: Column) -> Column:
    return F.schema_of_variant(leaf)


def string(v: Column) -> Column:
    """A string; null of all else."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _said(ok: Column | bool, text: Column | str) -> Column:
    return F.struct((ok if isinstance(ok, Column) else F.lit(ok)).alias("ok"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))


def opened(v: Column, *keys: str, **inner: tuple[str, ...]) -> Column:
    """These fields of an object as a struct, all found in one pass; null of anything else. Fields of `inner` are opened as well."""
    struct = lambda fields: "struct<" + ",".join(f"`{k}`:{kind}" for k, kind in fields.items()) + ">"
    return F.try_variant_get(v, "$", struct(dict.fromkeys(keys, "variant") | {k: struct(dict.fromkeys(ks, "variant")) for k, ks in inner.items()}))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _part(v: Column, skip_tools: bool) -> Column:
    """(ok, text) of an object or leaf within content; not ok where only a walk tells."""

    def told(p: Column) -> Column:
        odd = lambda k: p[k].isNotNull() & string(p[k]).isNull()
        own = string(p[V.TEXT_KEYS[0]])
        plain = F.coalesce(own.rlike(r"(?U)\S"), F.lit(False))
        if not skip_tools:
            return F.when(plain, _said(True, own)).otherwise(_said(False, ""))
        named = F.lower(F.concat_ws(" ", string(p["type"]), string(p["name"]))).rlike("|".join(V.TOOL_FRAGMENTS))
        tool = (F.lower(F.coalesce(string(p["role"]), F.lit(""))) == "tool") | named | F.coalesce(*[p[k] for k in V.TOOL_KEYS]).isNotNull()
        return F.when(odd("type") | odd("name") | odd("role"), _said(False, "")).when(tool, _said(True, "")).when(plain, _said(True, own)).otherwise(_said(False, ""))

    leaf = lambda: F.when(_kind(v) == "STRING", _said(True, F.try_variant_get(v, "$", "string"))).otherwise(_said(_kind(v) == "VOID", ""))
    return _once(opened(v, *PART), lambda p: F.when(p.isNotNull(), told(p)).when(elements(v).isNotNull(), _said(False, "")).otherwise(leaf()))


def _content(v: Column, skip_tools: bool) -> Column:
    """(ok, text) of content: a string, a list of parts, or a part."""
    joined = lambda p: F.array_join(F.transform(F.filter(p, lambda x: x["text"].rlike(r"(?U)\S")), lambda x: x["text"]), "\n\n")
    of_list = lambda p: _said(F.forall(p, lambda x: x["ok"]), joined(p))
    return _once(elements(v), lambda es: F.when(es.isNotNull(), _once(F.transform(es, lambda e: _part(e, skip_tools)), of_list)).otherwise(_part(v, skip_tools)))


def _roles(r: Column, m: Column) -> Column:
    """The roles that an object and what lies in it name: top, payload, inner."""
    word = lambda s, k: string(s[k])
    kind = F.lower(F.coalesce(word(r["payload"], "type"), F.lit("")))
    top = F.coalesce(role_of(word(r, "role")), role_of(word(r, "type")))
    payload = F.coalesce(role_of(word(r["payload"], "role")), F.when(kind.startswith("agent"), "assistant").when(kind.startswith("user"), "user"))
    inner = F.coalesce(role_of(word(m, "role")), role_of(word(r, "type")))
    return F.struct(*[F.coalesce(x, F.lit("assistant")).alias(n) for n, x in (("top", top), ("payload", payload), ("inner", inner))])


def _listed(r: Column, m: Column, roles: Column) -> Column:
    """All that an object may say, as array<struct<ordinal, role, c, source>>; c is null where there is none."""
    places = [("payload", r["payload"][k], f"payload.{k}") for k in ("content", "message", "summary", "text")]
    places += [("inner", m[k], f"message.{k}") for k in ("content", "text", "message")]
    places += [("top", F.when(m.isNull(), r["message"]), "message")] + [("top", r[k], k) for k in ("content", "text", "summary", "body")]
    return F.array(*[F.struct(F.lit(n).alias("ordinal"), roles[name].alias("role"), c.alias("c"), F.lit(source).alias("source")) for n, (name, c, source) in enumerate(places)])


def _first_time(s: Column) -> Column:
    """The first time that a struct of fields names."""
    return F.coalesce(*[F.nullif(F.regexp_replace(string(s[k]), r"(?U)\A\s+|\s+\z", ""), F.lit("")) for k in V.TIME_KEYS])


def _time(r: Column, m: Column, own: Column) -> Column:
    """(ok, text): the first time that the record or an object within it names; not ok where it may lie deeper."""
    inside = (r["payload"], m, r["snapshot"])
    deeper = functools.reduce(Column.__or__, [opened(s[k], V.TIME_KEYS[0]).isNotNull() for s in inside for k in WITHIN])
    within = F.coalesce(*[_first_time(s) for s in inside])
    return F.when(own.isNotNull(), _said(True, own)).when(deeper, _said(False, F.lit(None).cast("string"))).otherwise(_said(True, within))


def with_told(df: DataFrame, skip_tools: bool = True) -> DataFrame:
    """df (v, a record) with told, struct<timestamp, found>: what the record says; null where v is null or Python must read it. Each step is a column, so that none is worked out twice."""
    none = F.lit(None).cast("string")
    plain = lambda x: F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("assistant").alias("role"), x.alias("text"), F.lit("plain_text").alias("source"))).cast(FOUND)
    said = lambda x: F.struct(x["ordinal"].alias("ordinal"), x["role"].alias("role"), _content(x["c"], skip_tools).alias("said"), x["source"].alias("source"))
    bare = F.transform(F.filter("__said", lambda x: x["said"]["text"] != ""), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["role"].alias("role"), x["said"]["text"].alias("text"), x["source"].alias("source")))
    single = F.filter("__bare", lambda x, k: ~F.exists(F.slice("__bare", F.lit(1), k), lambda y: (y["role"] == x["role"]) & (y["text"] == x["text"])))
    steps = {
        "__r": opened(F.col("v"), *[k for k in (*INSIDE, "body") if k not in ("payload", "snapshot")], payload=INSIDE, snapshot=INSIDE), "__m": opened(F.col("__r.message"), *INSIDE),
        "__object": F.col("__r").isNotNull(), "__roles": _roles(F.col("__r"), F.col("__m")), "__own": _first_time(F.col("__r")),
        "__listed": F.when(F.col("__object"), F.filter(_listed(F.col("__r"), F.col("__m"), F.col("__roles")), lambda x: x["c"].isNotNull())),
        "__time": F.when(F.col("__object"), _time(F.col("__r"), F.col("__m"), F.col("__own"))),
        "__said": F.transform("__listed", said), "__bare": bare,
        "told": F.when(F.col("__object"), F.when(F.col("__time.ok") & F.forall("__said", lambda x: x["said"]["ok"]), F.struct(F.col("__time.text").alias("timestamp"), F.when(F.size("__bare") > 1, single).otherwise(F.col("__bare")).cast(FOUND).alias("found"))))
        .when(F.col("__string").isNotNull(), F.struct(none.alias("timestamp"), plain(F.col("__string")).alias("found"))),
    }
    df = df.withColumn("__string", F.when(fields(F.col("v")).isNull(), string(F.col("v"))))
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df.drop("__string", *[x for x in steps if x.startswith("__")])


ROWS = f"at long, k int, timestamp string, found {FOUND}, error string"


def _by_python(rows: DataFrame, skip_tools: bool) -> DataFrame:
    """What Python reads from rows (trace_id, at, k, form, line): a document or odd file gives its records, a line one."""
    sane = lambda x: x if x is None else x.encode("utf-8", "replace").decode()  # noqa: E731  lone surrogates

    def said(record: object) -> tuple[str | None, list[dict]]:
        candidates, time = traces._candidates(record, skip_tools)
        return sane(time), [c | {"text": sane(c["text"])} for c in candidates]

    def read(form: str, line: str) -> Iterator[tuple]:
        if form in (logs.DOCUMENT, "odd"):
            found, error = traces._records(line, ".json" if form == logs.DOCUMENT else "")
            if error:
                yield 0, None, None, error
            for k, record in enumerate(found or []):
                yield k, *said(record), None
        else:
            yield None, *said(json.loads(line) if logs.is_json(line) else line), None

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r.trace_id, r.at if n is None else n, r.k, time, found, error) for r in frame.itertuples() for n, time, found, error in read(r.form, r.line)]
            yield pd.DataFrame(out, columns=["trace_id", "at", "k", "timestamp", "found", "error"])

    kind = rows.schema["trace_id"].dataType.simpleString()
    return rows.select("trace_id", "at", "k", "form", "line").mapInPandas(parse, f"trace_id {kind}, {ROWS}")


def told(lines: DataFrame, skip_tools: bool = True) -> DataFrame:
    """(trace_id, at, k, form, line, timestamp, found, error) of the records of lines (trace_id, at, k, form, line), written to the shared folder: found is what a record says; a line of a
    transcript stays in line. Lines are read once, and Python has no part in it where all records are plain.
    """
    v, none = F.col("v"), F.lit(None).cast("string")
    known = lines.withColumn("v", F.when(F.col("form").isin(logs.JSON_LINES, logs.DOCUMENT), value_of(F.col("line"))))
    listed = F.coalesce(elements(v), *[elements(at(v, k)) for k in V.LIST_KEYS])
    known = known.withColumn("listed", F.when(F.col("form") == logs.DOCUMENT, listed))
    each = known.select("trace_id", "at", "k", "form", "line", F.col("listed").isNotNull().alias("many"), F.posexplode(F.coalesce("listed", F.array("v"))).alias("pos", "v"))
    record = {"at": F.when(F.col("many"), F.col("pos").cast("long")).otherwise(F.col("at")), "form": F.when(F.col("many"), logs.JSON_LINES).otherwise(F.col("form")), "line": F.when(F.col("many"), F.to_json("v")).otherwise(F.col("line"))}
    read = with_told(each.withColumns(record), skip_tools)
    # a line that cannot be JSON is a text
    text = F.struct(none.alias("timestamp"), F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("assistant").alias("role"), F.col("line").alias("text"), F.lit("plain_text").alias("source"))).cast(FOUND).alias("found"))
    read = read.withColumn("told", F.coalesce("told", F.when((F.col("form") == logs.JSON_LINES) & ~F.col("line").rlike(BEGINS), text)))
    failed = F.col("form").isin(logs.BLANK, logs.UNREADABLE)
    # what Python must read keeps its text for the second look, and transcripts theirs; all else only what it says
    held = read.select("trace_id", "at", "k", "form", F.when(F.col("told").isNull() & ~failed, F.col("line")).alias("line"), "told.timestamp", "told.found", F.when(failed, F.coalesce("line", F.lit(V.EMPTY_TRACE))).alias("error"))
    held = stored(held, "records")
    open_ = F.col("found").isNull() & F.col("form").isin(logs.JSON_LINES, logs.DOCUMENT, "odd")
    rest = held.where(open_)
    return held if rest.isEmpty() else stored(held.where(~open_).unionByName(_by_python(rest, skip_tools).withColumns({"form": F.lit(logs.JSON_LINES), "line": none})), "records")


def messages_of(told: DataFrame, include_user: bool = True) -> DataFrame:
    """(trace_id, msg_index, role, text, timestamp, source) from what records say, and transcripts."""
    structured = told.where("found IS NOT NULL").select("trace_id", "at", "k", "timestamp", F.inline("found"))
    transcripts = told.where(F.col("form") == logs.TRANSCRIPT)
    blocks = traces.blocks_of(transcripts).select(
        "trace_id", F.col("block").alias("at"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("timestamp"), F.lit(0).alias("ordinal"), "role", "text", F.lit("content").alias("source"),
    )
    return settle(structured.unionByName(blocks), ["at", "k", "ordinal"], include_user)


def errors_of(told: DataFrame) -> DataFrame:
    return told.where("error IS NOT NULL").select("trace_id", "error")


def heads_of(lines: DataFrame, first: int = traces.SNIFFED) -> DataFrame:
    """trace_id, raw_index, record (JSON as Python writes it) of the first records of each log; a transcript's blocks are its records."""
    order = Window.partitionBy("trace_id").orderBy("at", "k")
    some = lines.where(F.col("form") == logs.JSON_LINES).withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    whole = lines.where(F.col("form").isin(logs.DOCUMENT, "odd")).withColumn("n", F.lit(1))

    def read(form: str, line: str) -> list[str]:
        if form == logs.JSON_LINES:
            return [json.dumps(json.loads(line) if logs.is_json(line) else line)]
        return [json.dumps(x) for x in (traces._records(line, ".json" if form == logs.DOCUMENT else "")[0] or [])[:first]]

    def dump(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r.trace_id, r.n - 1 + k, record) for r in frame.itertuples() for k, record in enumerate(read(r.form, r.line))]
            yield pd.DataFrame(out, columns=["trace_id", "raw_index", "record"])

    kind = lines.schema["trace_id"].dataType.simpleString()
    dumped = some.unionByName(whole).select("trace_id", "n", "form", "line").mapInPandas(dump, f"trace_id {kind}, raw_index int, record string")
    blocks = traces.blocks_of(lines.where(F.col("form") == logs.TRANSCRIPT)).where(F.col("block") < first)
    return dumped.unionByName(blocks.select("trace_id", F.col("block").cast("int").alias("raw_index"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("record")))
