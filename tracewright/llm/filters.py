"""Filters of keys as bitmaps: small enough to broadcast whatever the corpus holds, consulted before a shuffle.

A key of a filter is one bit in at most MOST_BITS (8 MB of bitmaps). A filter holds all its keys, and of others about one in BITS_A_KEY;
more where MOST_BITS is too few, so a filter saves shuffles and never decides by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import P

BITS_A_KEY, MOST_BITS = 16, 1 << 26
BUCKET, BITMAP = f"{P}bucket", f"{P}bitmap"


class Filter:
    """A filter of the distinct values of some columns in `keys`, a table that is read twice."""

    def __init__(self, keys: DataFrame, *columns: str) -> None:
        n, self.bits = keys.count(), 1 << 15
        while self.bits < min(MOST_BITS, BITS_A_KEY * n):
            self.bits <<= 1
        at = self._place(*columns)
        self.bitmaps = keys.groupBy(F.bitmap_bucket_number(at).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(BITMAP))

    def keep(self, path: str) -> Filter:
        """This filter, written to a path and read from there from now on."""
        kind = self.bitmaps.schema
        self.bitmaps.coalesce(1).write.parquet(path)  # MOST_BITS / 8 bytes at most
        self.bitmaps = self.bitmaps.sparkSession.read.schema(kind).parquet(path)
        return self

    def _place(self, *columns: str | Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits)) + 1

    def marked(self, rows: DataFrame, name: str, *columns: str) -> DataFrame:
        """rows with a boolean column: whether the filter may hold their values of these columns (those of `keys`, in their order)."""
        at = self._place(*columns)
        byte = F.conv(F.hex(F.substring(BITMAP, F.floor(F.bitmap_bit_position(at) / 8).cast("int") + 1, 1)), 16, 10).cast("long")
        held = F.call_function("bit_get", byte, (F.bitmap_bit_position(at) % 8).cast("int")) == 1
        # MOST_BITS / 8 bytes at most
        return rows.join(F.broadcast(self.bitmaps), F.bitmap_bucket_number(at) == F.col(BUCKET), "left").withColumn(name, F.coalesce(held, F.lit(False))).drop(BUCKET, BITMAP)

    def may_hold(self, rows: DataFrame, *columns: str) -> DataFrame:
        return self.marked(rows, f"{P}held", *columns).where(f"{P}held").drop(f"{P}held")
