"""Operator 7, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

1. Targets: sources share the corpus size by weight; no source gives more than `cap` times its size, and what is
   above is shared again by weight (closed form of the repeated sharing: sources sorted by size over weight fill up first).
2. Each source's documents are set in the order of a hash, a random permutation, and cut into blocks of words. A target
   is a quota of blocks: whole passes over the source, then the first blocks of the permuted order.
3. The tree: at its root lie all quota units of all sources. Every node permutes its units at random and hands the first
   half to its left child, so the counts by source at each child are multivariate hypergeometric and the quotas of the leaves
   (output shards) add up exactly. Units are numbered blocks, so the shards draw disjoint ones.
4. Documents meet their block's draws in a join; the rows of a shard are shuffled locally by the permutation.

The number of blocks is set by `blocks`, not by the data, so the tree is small at any size; where there are more than `SOURCES_A_TREE` sources, as
when each is a host, every so many have a tree of their own. Sources are ranked by a distributed sort, and the sharing of targets is repeated
as aggregates over them: the driver sees four numbers. Documents are ordered within cells of a source, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import P, WORD, stored, text_of, with_text

WEIGHTS, CAP, SHARDS, BLOCKS, ROWS_A_CELL, SOURCES_A_TREE = (5, 2, 1), 3, 16, 4096, 2_500, 1_000
#: Words of a shard's piece, about 64 MB of text: what one task shuffles and writes.
WORDS_A_PIECE = 10_000_000

SOURCE, SIZE, KEY, CELL, START, BLOCK = (f"{P}{x}" for x in ("source", "size", "key", "cell", "start", "block"))
HASH_SPACE = 2**32


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def permutation(doc_id: Column, seed: str) -> Column:
    """The key that orders a source at random, the same on every run."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes (SOURCE, SIZE), one row for each source, with its rank by code point from 1, null last: sorted over all tasks, whose counts alone meet in one."""
    partition = F.shiftright("at", 33)
    placed = stored(sizes.orderBy(F.col(SOURCE).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    counts = placed.groupBy(partition.alias("part")).agg(F.count("*").alias("n"))  # a row for each task of the sort
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(offsets, partition == F.col("part")).select(SOURCE, SIZE, (F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For a row per source (SOURCE, SIZE): rank, weight, all (size of the corpus), target (double).

    Sources share the size by weight; those that would get `cap` times their size or more are full, and the rest is shared again until none is new among them.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighted = stored(ranked(sizes).withColumn("weight", weight), "weighted-sources")
    whole = lambda x: (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(38,0)")  # noqa: E731  products may exceed a long
    sums = lambda df: [int(x or 0) for x in df.agg(F.sum(SIZE), F.sum("weight"), F.count("*")).first()]
    everything, every_weight, n = sums(weighted)
    left, share, full, known = everything, every_weight, F.lit(False), -1
    while share and known < n:
        full = whole(F.col("weight")) * whole(left) >= whole(F.col(SIZE)) * whole(cap * share)
        size, weight_, count = sums(weighted.where(full))
        if count == known:
            break
        known, left, share = count, everything - cap * size, every_weight - weight_
    if known == n:
        full = F.lit(True)
    target = F.when(full, (cap * F.col(SIZE)).cast("double")).otherwise((F.col("weight") * F.lit(left)).cast("double") / F.lit(max(1, share)))
    return weighted.select(SOURCE, SIZE, "rank", "weight", F.lit(everything).cast("long").alias("all"), target.alias("target"))


def draws_by_shard(plan: DataFrame, shards: int, seed: str, sources_a_tree: int = SOURCES_A_TREE) -> DataFrame:
    """The splitting tree: (rank, epoch, BLOCK, shard) for every quota unit of the plan's sources."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    unit = plan.where("quota > 0").select("rank", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("unit"))
    tree = unit.withColumns({"shard": F.lit(0).cast("long"), "tree": F.floor((F.col("rank") - 1) / sources_a_tree)})
    for level in range(shards.bit_length() - 1):
        node = Window.partitionBy("tree", "shard")
        urn = node.orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}{level}"), "rank", "unit")), "rank", "unit")
        right = 2 * F.row_number().over(urn) > F.count("*").over(node) + 1
        tree = tree.withColumn("shard", 2 * F.col("shard") + right.cast("long"))
    return tree.select("rank", F.floor(F.col("unit") / F.col("n_blocks")).alias("epoch"), (F.col("unit") % F.col("n_blocks")).alias(BLOCK), "shard")


def drawn(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, blocks: int = BLOCKS, seed: str = "mix:", rows_a_cell: int = ROWS_A_CELL) -> tuple[DataFrame, int]:
    """The words of all docs, and docs with SIZE, KEY, START, source_size, target and draws: array<struct<epoch, shard, words>>, one element for each time the mix takes the document, wholly or in part."""
    if "source" not in docs.columns:
        raise ValueError("documents need a source")
    cells = max(1, -(-docs.count() // rows_a_cell))
    key = permutation(docs["doc_id"], seed)
    cell = F.floor(F.conv(F.substring(KEY, 1, 8), 16, 10).cast("long") * cells / HASH_SPACE)  # cells follow the order of the keys
    sized = docs.withColumns({SOURCE: docs["source"], SIZE: n_words(text_of(docs)), KEY: key}).withColumn(CELL, cell)
    by_cell = stored(sized.groupBy(SOURCE, CELL).agg(F.sum(SIZE).alias("cell_size")), "cells")
    sizes = by_cell.groupBy(SOURCE).agg(F.sum("cell_size").alias(SIZE))
    block_words = F.greatest(F.lit(1), F.ceil(F.col("all") / blocks))
    take = F.floor(F.col("target") + 0.5)
    plan = stored(
        targets(sizes, weights, cap)
        .withColumns({"block_words": block_words, "take": take, "n_blocks": F.ceil(F.col(SIZE) / block_words)})
        .withColumns({"epochs": F.when(F.col(SIZE) > 0, F.floor(F.col("take") / F.col(SIZE))).otherwise(0), "rest": F.when(F.col(SIZE) > 0, F.col("take") % F.col(SIZE)).otherwise(0)})
        .withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.ceil(F.col("rest") / F.col("block_words"))),
        "mix-plan",
    )
    earlier = Window.partitionBy(SOURCE).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    offsets = starts.join(plan.withColumnRenamed(SIZE, "source_size").withColumnRenamed(SOURCE, f"{P}source2"), F.col(SOURCE).eqNullSafe(F.col(f"{P}source2")))
    facts = offsets.select(
        F.col(SOURCE).alias(f"{P}source3"), F.col(CELL).alias(f"{P}cell3"),
        F.struct("rank", "source_size", "target", "block_words", "epochs", "rest", "cell_start").alias(f"{P}plan"),
    )
    before = Window.partitionBy(SOURCE, CELL).orderBy(KEY, "doc_id", SIZE).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn(f"{P}before", F.coalesce(F.sum(SIZE).over(before), F.lit(0)))
        .join(stored(facts, "cell-facts"), F.col(SOURCE).eqNullSafe(F.col(f"{P}source3")) & (F.col(CELL) == F.col(f"{P}cell3")))
        .withColumn(START, F.col(f"{P}plan.cell_start") + F.col(f"{P}before"))
        .withColumns({f"{P}rank": F.col(f"{P}plan.rank"), BLOCK: F.floor(F.col(START) / F.col(f"{P}plan.block_words"))})
    )
    tree = draws_by_shard(plan, shards, seed).groupBy("rank", BLOCK).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias(f"{P}units"))
    joined = placed.join(stored(tree.withColumnRenamed("rank", f"{P}rank"), "draws"), [f"{P}rank", BLOCK], "left")
    words = lambda u: F.when(u["epoch"] < F.col(f"{P}plan.epochs"), F.col(SIZE)).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col(SIZE), F.col(f"{P}plan.rest") - F.col(START))))
    taken = F.transform(F.coalesce(f"{P}units", F.array().cast("array<struct<epoch:bigint,shard:bigint>>")), lambda u: F.struct(u["epoch"].alias("epoch"), u["shard"].alias("shard"), words(u).alias("words")))
    first = plan.select("all").first()
    return joined.withColumns({f"{P}draws": F.filter(taken, lambda u: u["words"] > 0)}), first["all"] if first else 0


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken.

    A null source is a source of its own, the last. Null and empty texts have size 0 and are never taken. Ties and repeated
    rows: each row counts by itself; rows alike in doc_id and size are interchangeable. Only doc_id, source and text are
    read. An empty table gives an empty result; if all texts are empty every target is 0.
    """
    rows, _ = drawn(docs.select("doc_id", "source", "text"), **options)
    total = F.aggregate(f"{P}draws", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    return rows.select("doc_id", "source", F.col(SIZE).alias("size"), F.col(f"{P}plan.source_size").alias("source_size"), F.col(f"{P}plan.target").alias("target"), total.alias("taken"))


def mixture(docs: DataFrame, words_a_piece: int = WORDS_A_PIECE, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time a document is taken, in shards, shuffled locally.

    A document that the end of its source's last pass cuts gives its first words, joined by single spaces: one document for each source at most.
    A shard is as many pieces as its words fill, so none is one task. Null and empty texts are never taken; a null source is one of
    its own. Repeated rows count each by itself, ties are broken by a hash, other columns stay as they are, an empty table stays empty.
    """
    columns = docs.columns
    rows, words = drawn(docs, **options)
    rows = rows.withColumn(f"{P}draw", F.explode(f"{P}draws"))
    whole = F.col(f"{P}draw.words") == F.col(SIZE)
    cut = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col(f"{P}draw.words").cast("int")), " ")
    local = F.md5(F.concat_ws(":", KEY, f"{P}draw.epoch"))
    # the shares of all sources add up to the words of the corpus
    shards = options.get("shards", SHARDS)
    pieces = max(1, -(-words // (shards * words_a_piece)))
    dealt = with_text(rows, F.when(whole, F.col("text")).otherwise(cut)).withColumns({f"{P}shard": F.col(f"{P}draw.shard"), f"{P}local": local})
    dealt = dealt.withColumn(f"{P}piece", F.pmod(F.xxhash64(f"{P}local"), F.lit(pieces)))
    return dealt.repartition(shards * pieces, f"{P}shard", f"{P}piece").sortWithinPartitions(f"{P}shard", f"{P}piece", f"{P}local").select(*columns)
