"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.scratch import shared_folder, stored

__all__ = ["BLANKS", "P", "WORD", "documents", "shared_folder", "ship", "stored", "text_of", "with_text"]

#: A word is a run of characters other than these six white-space characters (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

#: Prefix of every internal column, so that columns of the input never clash with ours.
P = "__tw_"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(docs[column], F.lit(""))


#: What a batch that Spark hands to a Python worker may hold: its other bound, 10,000 rows, says nothing where texts are long.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each SparkContext; tasks import their functions from it. Bound the bytes of Arrow batches in this session, unless a smaller bound is set."""
    context = spark.sparkContext
    held = spark.conf.get(BATCH, None)
    if held is None or not 0 < int(held.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if getattr(context, "_tracewright_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir=tempfile.gettempdir())) / "tracewright_tasks.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tracewright_shipped = True


def with_text(docs: DataFrame, changed: Column) -> DataFrame:
    """docs with a new text; n_chars, where there is one, follows it."""
    out = docs.withColumn("text", changed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
