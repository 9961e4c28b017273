"""Operator 12, hard-negative mining: a norm-bucketed search for inner products.

Candidates are sorted by norm, longest first, and cut into buckets, ranges of norms; a bucket is held by tasks in pieces of bounded size. An anchor
visits a bucket only if the bucket's longest vector can reach what the anchor still asks for: by Cauchy and Schwarz no score there is above the product of the two
norms. What it asks for is the lower limit of each of its windows and, once a window is full, the score of its kth row. Two rounds: the longest bucket gives
first kth scores, which then say how far down each anchor goes; within a piece the same bound skips blocks as the scores rise.

Scores are exact integers. Anchors, a stated hundredth of the rows, travel to the pieces; candidates are dealt out once for each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import P, ship, stored

POSITIVES, NEGATIVES, SCALE, EVERY = 5, 5, 256, 100
#: Rows of a bucket at least, buckets at most, rows of a piece, which a task holds, of a block, and anchors that meet a block at once.
BUCKET, BUCKETS, PIECE, BLOCK, TOGETHER = 4096, 4096, 16_384, 2048, 256
#: Of a sum below this, double arithmetic is exact.
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1
NUMBER, MARK, LABEL, VECTOR, SQUARE, AT, PIECE_AT = (f"{P}{x}" for x in ("number", "mark", "label", "vector", "square", "bucket", "piece"))
FOUND = f"{NUMBER} long, {MARK} long, window int, score long, found long"


def vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """NUMBER (vec_id), LABEL after its change, VECTOR of whole numbers, SQUARE (its squared length), MARK (tells rows of one vec_id apart) of the rows that take part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = embeddings["label"].cast("long")
    rows = embeddings.where(label.isNotNull() & embeddings["embedding"].isNotNull() & ~F.exists(embeddings["embedding"], odd))
    moved = F.when(F.coalesce(embeddings["vec_id"] % 7 == 0, F.lit(False)), F.pmod(label + 1, F.lit(10))).otherwise(label)
    whole = F.transform(embeddings["embedding"], lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(embeddings["vec_id"].cast("long").alias(NUMBER), moved.alias(LABEL), whole.alias(VECTOR))
    return rows.withColumns({SQUARE: F.aggregate(VECTOR, F.lit(0).cast("long"), lambda n, x: n + x * x), MARK: F.xxhash64(LABEL, VECTOR)})


def bucketed(rows: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, list[tuple[int, float, int]]]:
    """rows (a stored table) with AT, their bucket in the order of norms, and PIECE_AT; (bucket, longest norm, pieces) of each bucket, BUCKETS at most."""
    parts = int(min(BUCKETS, max(1, -(-rows.count() // bucket))))
    dealt = rows.repartitionByRange(parts, F.desc(SQUARE), F.asc(NUMBER), F.asc(MARK)).withColumn(AT, F.spark_partition_id())
    # a piece holds neighbours in the order of norms, so that its longest vector bounds it well
    dealt = dealt.withColumn(PIECE_AT, F.floor((F.row_number().over(Window.partitionBy(AT).orderBy(F.desc(SQUARE), NUMBER)) - 1) / PIECE).cast("int"))
    dealt = stored(dealt, "norm-buckets")
    facts = dealt.groupBy(AT).agg(F.max(SQUARE).alias("longest"), F.max(PIECE_AT).alias("last")).orderBy(AT).collect()  # BUCKETS rows at most
    return dealt, [(r[AT], float(np.sqrt(float(r["longest"]))), r["last"] + 1) for r in facts]


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Whole numbers: by doubles, where they are exact, or by longs."""
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if exact else a @ b.T


def _matrix(column: pa.ListArray) -> np.ndarray:
    """One row for each list, short ones filled up with zeros."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _wider(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Piece:
    """The candidates of a piece in blocks, longest norms first; within a block by vec_id."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        width = max(p[2].shape[1] for p in parts)
        numbers, labels, matrix, squares = (np.concatenate([_wider(p[k], width) if k == 2 else p[k] for p in parts]) for k in range(4))
        order = np.argsort(-squares, kind="stable")
        self.blocks = []
        for at in range(0, len(order), BLOCK):
            own = order[at : at + BLOCK]
            own = own[np.argsort(numbers[own], kind="stable")]
            self.blocks.append((numbers[own], labels[own], matrix[own], float(np.sqrt(float(squares[own].max())))))

    def search(self, numbers: np.ndarray, labels: np.ndarray, matrix: np.ndarray, squares: np.ndarray, lows: np.ndarray, tops: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(row, window, score, candidate): for each window [low, top] of each row its k best candidates here."""
        norms, needed = np.sqrt(squares.astype(float)), lows.copy()
        rows = windows = scores = found = np.zeros(0, np.int64)
        for others, their_labels, theirs, longest in self.blocks:
            reach = norms * longest * (1 + 1e-9)
            asks = (needed <= reach[:, None]) & (lows <= tops)
            active = np.flatnonzero(asks.any(axis=1))
            if not len(active):
                continue
            width = max(matrix.shape[1], theirs.shape[1])
            product = _products(_wider(matrix[active], width), _wider(theirs, width), float(norms[active].max()) * longest < EXACT / 2)
            alike = labels[active][:, None] == their_labels
            fits = alike & (numbers[active][:, None] != others) if same else ~alike
            for w in range(lows.shape[1]):
                inside = fits & asks[active, w][:, None] & (product >= needed[active, w][:, None]) & (product <= tops[active, w][:, None])
                if inside.shape[1] > k:  # only what reaches the kth of this block
                    held = np.where(inside, product, LOWEST)
                    inside &= product >= np.partition(held, -k, axis=1)[:, -k][:, None]
                x, y = np.nonzero(inside)
                rows, windows = np.append(rows, active[x]), np.append(windows, np.full(len(x), w))
                scores, found = np.append(scores, product[x, y]), np.append(found, others[y])
            key = rows * lows.shape[1] + windows
            order = np.lexsort((found, -scores, key))
            key, rows, windows, scores, found = (v[order] for v in (key, rows, windows, scores, found))
            rank = np.arange(len(key)) - np.searchsorted(key, key)
            kth = rank == k - 1
            needed[rows[kth], windows[kth]] = np.maximum(needed[rows[kth], windows[kth]], scores[kth])
            keep = rank < k
            rows, windows, scores, found = (v[keep] for v in (rows, windows, scores, found))
        return rows, windows, scores, found


def visits(asking: DataFrame, candidates: DataFrame, facts: list[tuple[int, float, int]], same: bool, k: int) -> DataFrame:
    """FOUND for each window of `asking` (NUMBER, MARK, LABEL, VECTOR, SQUARE, lows, tops): its k best candidates in each piece of the buckets of `facts` that it can reach, all of the same or of other labels."""
    if not facts:
        return asking.sparkSession.createDataFrame([], FOUND)
    low = F.array_min(F.zip_with("lows", "tops", lambda a, b: F.when(a <= b, a)))  # of windows that hold anything
    # buckets come by falling norm: an anchor visits as many as reach its lowest limit
    reached = lambda longest: low <= F.sqrt(F.col(SQUARE).cast("double")) * F.lit(longest) * (1 + 1e-9)
    places = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(pieces).alias("pieces"), F.lit(longest).alias("longest")) for at, longest, pieces in facts])
    near = F.filter(places, lambda b: F.coalesce(reached(b["longest"]), F.lit(False)))
    to = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), b["pieces"] - 1), lambda p: F.struct(b["at"].alias(AT), p.alias(PIECE_AT)))))
    columns = [NUMBER, MARK, LABEL, VECTOR, SQUARE]
    sent = asking.select(*columns, "lows", "tops", F.explode(to).alias("to")).select("to.*", F.lit(1).alias("asks"), *columns, "lows", "tops")
    none = F.lit(None).cast("array<long>")
    here = candidates.where(F.col(AT).between(facts[0][0], facts[-1][0])).select(AT, PIECE_AT, F.lit(0).alias("asks"), *columns, none.alias("lows"), none.alias("tops"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, piece = None, [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                if (own := tuple(where[a][:2])) != key:
                    key, parts, piece = own, [], None
                for at in range(a, b, TOGETHER if where[a][2] else BLOCK):
                    part = batch.slice(at, min(b - at, TOGETHER if where[a][2] else BLOCK))
                    numbers = part.column(3).fill_null(HIGHEST).to_numpy(zero_copy_only=False)
                    marks, labels, squares = (part.column(c).to_numpy(zero_copy_only=False) for c in (4, 5, 7))
                    if not where[a][2]:
                        parts.append((numbers, labels, _matrix(part.column(6)), squares))
                        continue
                    if not parts:
                        continue
                    piece = piece or Piece(parts)
                    lows = _matrix(part.column(8))
                    tops = _matrix(part.column(9))
                    n = part.column(8).value_lengths().to_numpy(zero_copy_only=False)
                    tops[np.arange(tops.shape[1]) >= n[:, None]] = LOWEST  # rows with fewer windows
                    lows[np.arange(lows.shape[1]) >= n[:, None]] = HIGHEST
                    rows, windows, scores, found = piece.search(numbers, labels, _matrix(part.column(6)), squares, lows, tops, same, k)
                    told = pa.array(found, mask=found == HIGHEST)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[rows]), pa.array(marks[rows]), pa.array(windows.astype(np.int32)), pa.array(scores), told], [NUMBER, MARK, "window", "score", "found"])

    ship(asking.sparkSession)
    both = here.unionByName(sent).repartition(AT, PIECE_AT).sortWithinPartitions(AT, PIECE_AT, "asks")
    return both.mapInArrow(search, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """found with rank: the k best of each window."""
    order = Window.partitionBy(NUMBER, MARK, "window").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(asking: DataFrame, candidates: DataFrame, facts: list[tuple[int, float, int]], same: bool, k: int) -> DataFrame:
    """The k best candidates of each window, from all buckets: those of the longest norms first, then the others as far as they can still count."""
    first = stored(best(visits(asking, candidates, facts[:1], same, k), k), "first-found")
    if len(facts) < 2:
        return first
    kth = first.where(F.col("rank") == k).groupBy(NUMBER, MARK).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # a few windows each
    told = asking.join(kth.withColumnsRenamed({NUMBER: f"{P}n", MARK: f"{P}m"}).hint("merge"), (F.col(NUMBER) == F.col(f"{P}n")) & (F.col(MARK) == F.col(f"{P}m")), "left")
    lows = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w), low)))
    rest = visits(told.withColumn("lows", lows), candidates, facts[1:], same, k)
    return best(first.drop("rank").unionByName(rest), k)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = 80, every: int = EVERY, scale: int = SCALE, bucket: int = BUCKET) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `positives` the best rows of other labels
    that score at least `percent` hundredths of the positive, and no more than it.

    Anchors are the rows whose vec_id is divisible by `every`. Rows with a null label or vector, or a component that is null or not finite, take no part; a label
    moves to (label + 1) % 10 where 7 divides vec_id. Scores are inner products of floor(scale * x); ties go by vec_id. A row with a null vec_id is a candidate,
    after all others of its score. Rows that share an anchor's vec_id are not its positives; other repeated rows each count. Anchors that repeat as a whole
    count once. A shorter vector counts as filled up with zeros. A vector whose squared length is beyond a long is an error. Only vec_id, label and embedding are read;
    an empty table gives an empty result.
    """
    rows = stored(vectors(embeddings, scale), "vectors")
    candidates, facts = bucketed(rows, bucket)
    wide = F.array(F.lit(LOWEST)), F.array(F.lit(HIGHEST))
    anchors = rows.where(F.col(NUMBER) % every == 0).dropDuplicates([NUMBER, LABEL, VECTOR])
    near = stored(searched(anchors.withColumns({"lows": wide[0], "tops": wide[1]}), candidates, facts, True, positives).drop("window"), "positives")
    # a window for each positive: from the least whole number that is `percent` hundredths of its score to the score
    limit: Column = F.ceil(F.col("score") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = near.groupBy(NUMBER, MARK).agg(F.array_sort(F.collect_list(F.struct("rank", limit.alias("low"), F.col("score").alias("top")))).alias("w"))
    windows = windows.select(F.col(NUMBER).alias(f"{P}n2"), F.col(MARK).alias(f"{P}m2"), F.col("w.low").alias("lows"), F.col("w.top").alias("tops"))
    asking = stored(anchors.join(windows.hint("merge"), (F.col(NUMBER) == F.col(f"{P}n2")) & (F.col(MARK) == F.col(f"{P}m2"))).drop(f"{P}n2", f"{P}m2"), "anchors")
    far = searched(asking, candidates, facts, False, negatives).withColumn("window", F.col("window") + 1)
    asked = near.select(NUMBER, MARK, F.col("rank").alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(asked.hint("merge"), [NUMBER, MARK, "window"])
    return out.select(F.col(NUMBER).alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
