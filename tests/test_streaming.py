"""Streams over micro-batches against the batch result, with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators.episodes import COLUMNS, episodes
from tracewright.plans.fixtures import narrated
from tracewright.streaming import state

SCHEMA = "trace_id long, msg_index long, role string, text string, timestamp string, source string"


@pytest.fixture(scope="module")
def messages(spark):
    """Six traces of some hundred messages, cut short so that their ends differ."""
    return narrated(spark, "/root/testdata/sf0.01").where("trace_id < 6 AND msg_index < 60 + 17 * trace_id").collect()


def rows(df):
    return sorted(map(repr, df.select(*COLUMNS).collect()))


def feed(spark, folder, some, k):
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/part={k:03}")


@pytest.mark.parametrize("kind", ["in_order", "shuffled"])
def test_random_batches_and_restarts_give_the_batch_result(spark, messages, tmp_path, kind):
    pick = random.Random(3)
    some = sorted(messages, key=lambda m: m.msg_index) if kind == "in_order" else pick.sample(messages, len(messages))
    cuts = sorted(pick.sample(range(len(some)), 4))
    parts = [some[a:b] for a, b in zip([0, *cuts], [*cuts, len(some)], strict=True)]
    parts[2] = parts[2] + parts[0][:5]  # some come again
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    for k, part in enumerate(parts):
        feed(spark, f"{tmp_path}/in", part, k)
        if k % 2 or k == len(parts) - 1:  # each run starts from the checkpoint of the one before
            state.run(stream(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    batch = episodes(spark.createDataFrame(messages, SCHEMA))
    assert rows(state.latest(out)) == rows(batch) and batch.count() > 10
    before = out.count()
    state.run(stream(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()  # nothing new
    assert spark.read.parquet(f"{tmp_path}/out").count() == before
    # what went out as final never changed
    final = out.where("final").groupBy("trace_id", "episode_no").agg(F.count("*").alias("n"), F.max("end_index").alias("last"))
    assert final.where("n > 1").count() == 0 and final.count() > 5


def test_a_silent_trace_ends_with_what_waits(spark, tmp_path):
    said = [(1, 0, "assistant", "The test failed with an error.", "2026-01-01T00:00:00Z", "s"), (1, 2, "assistant", "Instead I hit a problem, an issue, a bug.", "2026-01-01T00:00:09Z", "s")]
    feed(spark, f"{tmp_path}/in", said, 0)
    stream = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    state.run(stream(), f"{tmp_path}/out", f"{tmp_path}/check", silence_ms=1).awaitTermination()
    first = state.latest(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert [(r.end_index, r.final) for r in first] in ([(0, False)], [(0, True)])
    feed(spark, f"{tmp_path}/in", [(2, 0, "user", "Hello.", None, "s")], 1)
    state.run(stream(), f"{tmp_path}/out", f"{tmp_path}/check", silence_ms=1).awaitTermination()
    last = state.latest(spark.read.parquet(f"{tmp_path}/out")).where("trace_id = 1").orderBy("episode_no").collect()
    assert last[-1].end_index == 2 and last[-1].final


def test_islands_of_a_few_messages():
    m = lambda i, role="assistant", c=False, n=False, o=False: (i, role, "t", None, c, n, o)
    assert state.islands([m(0, n=True), m(1, "user"), m(2, c=True), m(3), m(4, o=True), m(5), m(6), m(7, c=True)]) == [(0, 4), (7, 7)]
    assert state.islands([m(0, c=True), m(1, "user"), m(2, "user"), m(3, "user"), m(4)]) == [(0, 0)]
