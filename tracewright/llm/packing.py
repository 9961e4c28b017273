"""Operator 2, packing: concatenate and cut.

Pass 1 encodes every text, each followed by an end id, and notes its place in its partition. The totals of the
partitions, one small row each, become offsets of partitions by a prefix sum. Pass 2 adds the two to a place in the one
stream of all ids and cuts that at fixed windows: a document that crosses a boundary leaves a record on both sides. Only
the last sequence is padded. Ids are written once to the shared folder, so both passes see the same partitions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import P, ship, stored, text_of
from tracewright.llm.word_encoder import encoder, slices

LENGTH, END_ID = 2048, 1
#: So many partitions' offsets are broadcast at most (16 bytes each).
MOST_BROADCAST = 500_000


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Pass 1: doc_id, part, before (ids before it in its partition), doc_tokens, ids (unsigned 32-bit, little-endian)."""
    end = np.asarray([end_id], "<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, ids_of = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in slices(batches):
            ids = [x + end for x in ids_of(batch.column("text").to_pylist())]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            # one array of offsets and bytes; from_arrays checks the schema against Spark's
            columns = [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "doc_tokens", "ids"])

    ship(docs.sparkSession)
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    return texts.mapInArrow(encode, f"doc_id {id_type}, part long, before long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary.

    `boundary` says that the document goes on in the next sequence. A null or empty text is its end id alone. Repeated
    rows are packed each; ties do not arise, for the order is that of the partitions. A null doc_id stays null. Only
    doc_id and text are read. A very long text is cut into as many pieces as it needs (its ids are one value of a column, so
    2 ** 29 of them at most: a text of over 2 GB, which Spark's own strings cannot be). An empty table gives no piece. with_ids adds the piece's ids (binary).
    """
    first = stored(encoded(docs, tokenizer, end_id), "packed-ids", compression="zstd")
    totals = first.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias(f"{P}offset")), "packed-offsets")
    placed = first.join(F.broadcast(offsets) if offsets.count() <= MOST_BROADCAST else offsets, "part")
    start = F.col(f"{P}offset") + F.col("before")
    window = F.explode(F.sequence(F.floor(start / length), F.floor((start + F.col("doc_tokens") - 1) / length)))
    pieces = (
        placed.withColumn(f"{P}at", start)
        .withColumn("sequence_id", window)
        .withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * length - F.col(f"{P}at")), f"{P}end": F.least("doc_tokens", (F.col("sequence_id") + 1) * length - F.col(f"{P}at"))})
        .withColumn("length", F.col(f"{P}end") - F.col("start"))
        .withColumn("piece", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id",
        ((F.col(f"{P}at") + F.col("start")) % length).alias("offset"), (F.col(f"{P}end") < F.col("doc_tokens")).alias("boundary"), *["piece"] * with_ids,
    )


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, n_tokens, ids (binary of `length` ids, padded at the end). Other columns are left out; no piece gives no sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "piece")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little") * length)
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("held"))
    return held.select("sequence_id", "n_tokens", F.concat("held", F.substring(pad, F.lit(1), (4 * (length - F.col("n_tokens"))).cast("int"))).alias("ids"))
