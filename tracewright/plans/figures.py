"""What the stages of an analysis took and gave: rows, bytes, redactions and seconds, observed as the tables are written, without a second pass."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGES = ("extract", "redact", "chart", "classify")
SCHEMA = "stage string, ordinal int, rows long, bytes long, redactions long, seconds double"
log = logging.getLogger(__name__)


class Figures:
    """Give one to `analyze`; after it `relation` and `summary` tell. A stage that did not run has no row."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def watch(self, stage: str, df: DataFrame, text: str, redactions: str | None = None) -> DataFrame:
        """df, observed when it is first computed."""
        self.seen[stage] = Observation()
        told = F.coalesce(F.sum(redactions), F.lit(0)) if redactions else F.lit(0).cast("long")
        # a constant alone is no aggregate
        told = told if redactions else F.coalesce(F.max(told), F.lit(0).cast("long"))
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0).cast("long")).alias("bytes"), told.alias("redactions"))

    @contextmanager
    def timed(self, *stages: str) -> Iterator[None]:
        """What runs within took the time of these stages together."""
        began = time.monotonic()
        yield
        self.seconds |= dict.fromkeys(stages, time.monotonic() - began)

    def rows(self) -> list[tuple]:
        told = []
        for stage, observation in self.seen.items():
            if stage in self.seconds:  # else `get` would wait for ever
                got = observation.get
                told.append((stage, STAGES.index(stage), got["rows"], got["bytes"], got["redactions"], self.seconds[stage]))
        return sorted(told, key=lambda r: r[1])

    def relation(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)

    def summary(self) -> str:
        """One line, which the log gets too."""
        line = " | ".join(f"{stage} {rows} rows, {size} bytes, {redactions} redactions, {seconds:.2f} s" for stage, _, rows, size, redactions, seconds in self.rows())
        log.info("analysis: %s", line)
        return line
