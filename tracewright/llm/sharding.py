"""Operator 10, sharding: a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, a permutation given by an offset and a
stride hashed from its name. Shards take turns claiming their first free slot until the table is full, so shard loads
differ by one slot at most, and when a shard joins or leaves few slots change hands. Rows are placed by hashing their key to a slot: one
look-up in a broadcast table whose size is fixed by the parameter `slots`, never by the data. No shuffle.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import P

SLOTS = 4099
ROWS_A_FILE = 100_000
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot. `slots` must be prime; distinct shard names give distinct orders."""
    if not shards:
        raise ValueError("at least one shard is needed")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    digest = lambda name, use: int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:12], 16)
    at = [digest(s, "offset") % slots for s in shards]
    stride = [digest(s, "stride") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5 digest modulo the table's size. A null key counts as the text 'null'."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % slots).cast("long")


def table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The look-up table as a DataFrame of `slots` rows."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias(f"{P}slot", f"{P}shard"))
    return rows.select(F.col(f"{P}slot").cast("long").alias(f"{P}slot"), F.col(f"{P}shard").cast("int").alias(f"{P}shard"))


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot (long) and shard (int); columns of these names in df are replaced.

    Null keys share one slot; equal keys (ties, repeated rows) share their slot; an empty table stays empty. The
    texts are not looked at, so their nulls and lengths do not matter.
    """
    slotted = df.withColumn(f"{P}slot", slot_of(df[key], slots))
    placed = slotted.join(F.broadcast(table(df.sparkSession, shards, slots)), f"{P}slot")
    return placed.withColumns({"slot": F.col(f"{P}slot"), "shard": F.col(f"{P}shard")}).drop(f"{P}slot", f"{P}shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, rows_a_file: int = ROWS_A_FILE) -> None:
    """Write df as one folder for each shard, in files of about `rows_a_file` rows, each written by one task, however large the shard.

    Rows of a shard are dealt to its files by a hash of the row, so one key that a third of all rows have is spread too; rows that are alike in
    all columns share a file, which is written in turns of twice `rows_a_file`. Null keys go to the shard of their slot; equal keys (ties,
    repeated rows) share a shard; an empty table gives an empty folder; columns named shard and slot are replaced.
    """
    placed = place(df, key, shards, slots)
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    files = [max(1, -(-sizes.get(k, 0) // rows_a_file)) for k in range(len(shards))]
    hashed = [f.name for f in df.schema.fields if not re.search("map|variant", f.dataType.simpleString())]
    file = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.element_at(F.array(*map(F.lit, files)), F.col("shard") + 1))
    dealt = placed.withColumn(f"{P}file", file).repartition(sum(files), "shard", f"{P}file").drop(f"{P}file")
    dealt.write.option("maxRecordsPerFile", 2 * rows_a_file).partitionBy("shard").parquet(path)
