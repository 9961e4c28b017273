"""Episodes of a stream by keyed state: each trace keeps what its open episodes need, and nothing is read again.

What messages signal is told by built-in functions before the state, and codes after it. Between them each trace keeps its messages from the first episode on that later ones may still
change: a span looks two messages back and three on, so one that ends six before the newest message is final, goes out and is forgotten. Messages that come ahead of
others wait for these; one that comes again is passed over. Open episodes go out with each batch as they stand; `latest` keeps the newest of each. A timer ends a trace that
has been silent, with what still waits, and a time to live forgets it if the timer does not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState
from pyspark.sql.types import StructType

from tracewright.operators.episodes import COLUMNS, MOST_EPISODES, described, flagged

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
BACK, ON = 2, 3
KEPT = "messages string"
FIELDS = ["msg_index", "role", "text", "timestamp", "candidate", "intention", "outcome"]
SPANS = "episode_no long, start_index long, end_index long, combined string, start_time string, end_time string, version long, final boolean"
HOUR = 3_600_000


def islands(messages: list[tuple]) -> list[tuple[int, int]]:
    """(start, end) of the joined spans of candidates among messages (FIELDS) in order."""
    out: list[tuple[int, int]] = []
    for k, m in enumerate(messages):
        if not m[4]:
            continue
        start = next((b[0] for b in reversed(messages[max(0, k - BACK) : k]) if b[1] == "assistant" and b[5]), m[0])
        ahead = [a for a in messages[k + 1 : k + 1 + ON] if a[1] == "assistant"]
        end = next((a[0] for a in ahead if a[6]), ahead[-1][0] if ahead else m[0])
        if out and start <= out[-1][1] + 1:
            out[-1] = (min(start, out[-1][0]), max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _read(state: ListState) -> list[tuple]:
    return [tuple(m) for (kept,) in state.get() for m in json.loads(kept)]


class Episodes(StatefulProcessor):
    """State of a trace: `done` (index that comes next, episodes that are final, how often it was told), `open` (messages that may still matter), `ahead` (those that wait).

    Messages are kept as JSON, those of a batch in one value, because each value is a call of its own from Python to the store.
    """

    def __init__(self, key: str, silence_ms: int, ttl_ms: int) -> None:
        self.key, self.silence, self.ttl = key, silence_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "next long, closed long, version long", self.ttl)
        self.open = handle.getListState("open", KEPT, self.ttl)
        self.ahead = handle.getListState("ahead", KEPT, self.ttl)

    def _told(self, key: tuple, came: list[tuple], ended: bool) -> Iterator[pd.DataFrame]:
        after, closed, version = self.done.get() or (0, 0, 0)
        held = _read(self.open)
        waiting = {m[0]: m for m in _read(self.ahead)}
        fresh = {}
        for m in came:
            if m[0] >= after and m[0] not in waiting:
                fresh.setdefault(m[0], m)
        ready = waiting | fresh
        new = []
        while after in ready:
            new.append(ready.pop(after))
            after += 1
        if ended:  # what waited for messages that never came
            new += [ready.pop(i) for i in sorted(ready)]
        held += new
        last = held[-1][0] if held else -1
        spans = islands(held)
        final = [s for s in spans if ended or s[1] + BACK + ON < last]
        rows = []
        for n, (start, end) in enumerate(spans[: max(0, MOST_EPISODES - closed)]):
            said = [m for m in held if start <= m[0] <= end and m[1] == "assistant"]
            rows.append((*key, closed + n + 1, start, end, "\n\n".join(m[2] for m in said), said[0][3], said[-1][3], version + 1, n < len(final)))
        since = spans[len(final)][0] if len(final) < len(spans) else max(last - BACK + 1, final[-1][1] + 1 if final else 0)
        closed += len(final)
        if ended:
            self.open.clear()
            self.ahead.clear()
        else:
            keep = [m for m in held if m[0] >= since] if closed < MOST_EPISODES else []
            if keep:
                self.open.put([(json.dumps(keep),)])
            elif held:
                self.open.clear()
            if waiting.keys() <= ready.keys():  # none came to its turn: those of this batch join the others
                if more := [m for i, m in ready.items() if i not in waiting]:
                    self.ahead.appendValue((json.dumps(more),))
            elif ready:
                self.ahead.put([(json.dumps(list(ready.values())),)])
            else:
                self.ahead.clear()
        self.done.update((max(after, last + 1 if ended else 0), closed, version + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[self.key, *[c.split()[0] for c in SPANS.split(", ")]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's
        came = [m for frame in rows for m in zip(*[[None if x != x else x for x in frame[c].tolist()] for c in FIELDS], strict=True)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield from self._told(key, came, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._told(key, [], True)

    def close(self) -> None:
        pass


def stream_episodes(messages: DataFrame, silence_ms: int = HOUR, ttl_ms: int = 168 * HOUR) -> DataFrame:
    """The episodes (COLUMNS, version, final) of a stream of messages (trace_id, msg_index, role, text, timestamp), as they come to stand. msg_index is dense in each trace."""
    spark = messages.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    told = flagged(messages).select("trace_id", "msg_index", "role", "text", "timestamp", F.col("is_candidate").alias("candidate"), F.col("has_intention").alias("intention"), F.col("has_outcome").alias("outcome"))
    schema = StructType([told.schema["trace_id"], *StructType.fromDDL(SPANS).fields])
    spans = told.groupBy("trace_id").transformWithStateInPandas(Episodes("trace_id", silence_ms, ttl_ms), schema, "Append", "ProcessingTime")
    return described(spans).select(*COLUMNS, "version", "final")


def run(messages: DataFrame, out: str, checkpoint: str, once: bool = True, **state: int) -> StreamingQuery:
    """Write the episodes of a stream under `out`, each batch once, also after a restart from `checkpoint`. With `once` what is there is taken and the stream ends; a timer then goes off in a later run."""
    spark = messages.sparkSession
    writer = stream_episodes(messages, **state).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    if not once:
        return writer.start()
    held = spark.conf.get(IDLE, "true")
    spark.conf.set(IDLE, "false")  # a stream with timers would go on for them for ever
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(IDLE, held)


def latest(episodes: DataFrame) -> DataFrame:
    """The newest standing of each episode."""
    rest = [c for c in episodes.columns if c not in ("trace_id", "episode_no")]
    newest = episodes.groupBy("trace_id", "episode_no").agg(F.max_by(F.struct(*rest), F.struct("version", "final")).alias("e"))
    return newest.select("trace_id", "episode_no", "e.*")
