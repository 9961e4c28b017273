"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last keep the columns of documents. A document that is rejected, or that another of its group stands for, is gone for
all later stages; removed passages are gone from the texts; the mix repeats and cuts as its targets ask.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import line_dedup, mixing, near_dedup, packing, queries, toxicity
from tracewright.llm.common import P, documents, stored
from tracewright.sources.scratch import drop, owned, release, under

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: By application: the folder of the stage that began last.
_LEFT: dict[str, str] = {}


def tidy(stage: Stage) -> Stage:
    """The stage with its intermediate tables in a folder of its own, which goes when nothing reads the stage's result any more: each stage looks, as it begins, for folders that can go.
    Results of several stages or runs may be read in any order."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        with owned(spark, stage.__name__) as _LEFT[spark.sparkContext.applicationId]:
            return stage(spark, docs, sf_dir)

    return run


@tidy
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold. A null text is scored as an empty one and kept as it is; rows alike, repeated or
    not, are judged alike; columns stay as they are. An empty table stays empty."""
    net, thresholds = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"{P}score"
    return toxicity.scored(docs, net, score).where(~toxicity.rejected(thresholds, score)).select(*docs.columns)


@tidy
def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines, and then passages of over 50 words, that stand elsewhere before. A null text becomes an empty one;
    of the other columns only n_chars changes. Rows that repeat doc_id and text stay alike; a document of which nothing is left stays, empty."""
    with under(spark, "chunks") as folder:
        lines = line_dedup.line_dedup(docs, counted=False)
    lines = stored(lines, "lines")
    drop(spark, folder)
    return line_dedup.passage_dedup(lines)


@tidy
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id; empty documents stay. Rows that share a doc_id, repeated ones
    too, stay if any of them does. Other columns are not looked at; an empty table stays empty."""
    ids = near_dedup.near_dedup(docs).where("kept").select(F.col("doc_id").alias(f"{P}id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(f"{P}id")), "left_semi")


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time it takes a document; null and empty texts are not taken, a null source is one of its own. Repeated rows
    count each by itself, ties go by a hash, other columns stay as they are. An empty table stays empty."""
    return mixing.mixture(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: every row, repeated or not, is packed; a null or empty text as its end id. Of docs only doc_id and text
    are read. An empty table gives no piece."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [("toxicity", reject_toxic), ("line_dedup", remove_lines), ("near_dedup", keep_one), ("mixing", mix), ("packing", pack)]

#: SQL has no classifier or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
