"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import ship, stored

#: A graph of so many edges at most is finished in one task, some tens of megabytes; a larger one is contracted until it is so small.
AT_ONCE = 200_000


def _finished(edges: DataFrame) -> DataFrame:
    """(from, to) for the nodes of a graph of AT_ONCE edges at most: its components, by labels that go to the smaller neighbour until none changes."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ends = pa.concat_arrays([b.column(c) for c in ("a", "b") for b in held]).dictionary_encode()
        x, y = np.split(ends.indices.to_numpy(), 2)
        own = np.arange(len(ends.dictionary))
        while True:
            low = np.minimum(own[x], own[y])
            new = own.copy()
            np.minimum.at(new, own[x], low)
            np.minimum.at(new, own[y], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == own).all():
                break
            own = new
        yield pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(pa.array(own))], ["from", "to"])

    ship(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(label, f"from {kind}, to {kind}")


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): connected nodes share a root, itself one of them.

    Each round every node moves to the first of its neighbours and itself in an order that is drawn anew for the round, and edges become edges between
    where their ends moved; ends that met drop out, so the graph shrinks by a share, however nodes are named, until it has `at_once` edges at
    most and fits a task. Edges and moves of a round are written to the shared folder; nothing is collected, and no join is broadcast.
    """
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes, number, n = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), 0, left.count()
    while n:
        if n <= at_once:
            moves = stored(_finished(left), "moves")
        else:
            place = lambda x, number=number: F.struct(F.xxhash64(F.lit(number), x).alias("h"), F.col(x).alias("x"))
            both = left.union(left.select("b", "a"))
            moves = both.groupBy("a").agg(F.min(place("b")).alias("low")).select(F.col("a").alias("from"), F.least(place("a"), "low")["x"].alias("to"))
            moves = stored(moves, "moves")
        if number == 0:
            nodes = moves.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            nodes = nodes.join(moves.hint("merge"), F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        if n <= at_once:
            break
        first = left.join(moves.hint("merge"), F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        both_ends = first.join(moves.hint("merge"), F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
        left = stored(both_ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        n, number = left.count(), number + 1
    return nodes if number == 0 else stored(nodes, "components")
