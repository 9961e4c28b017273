"""Operator 1, near-dedup: fast similarity sketching, banding, exact verification.

Sketch: a set's shingles are thrown into `coordinates` bins, round after round, each round with a new hash; a bin keeps
the smallest value of the first round that reached it. From round `coordinates` on, round i throws everything into bin i modulo that number, so all
are filled after twice as many rounds at most (two or three rounds for most texts). Two sets agree in a coordinate
with a chance of their Jaccard similarity.

Banding: with 32 bands of 4 coordinates a pair at similarity 0.75 shares no band with a chance of (1 - 0.75^4)^32, 5 in a million, and a closer pair with less.

Verification on full sets: documents with equal sets are one class (by a 128-bit digest). In a bucket, a class is first checked against
two leaders of the bucket. Where that leaves a bucket in several components, everything outside its largest is compared
with all of the bucket in blocks. So close copies cost about two checks each, pairs are never listed, and
any two documents that share a band are either compared or already connected. Links become components by contraction. Nothing is capped, sampled
or collected. Joins are asked to merge: what they meet grows with the corpus, and the driver keeps no relations of the many rounds.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import P, ship, stored, text_of
from tracewright.llm.components import components
from tracewright.llm.filters import Filter
from tracewright.llm.word_encoder import slices

WORDS, PERCENT, COORDINATES, BANDS = 5, 75, 128, 32
#: Nodes, and shingles, of a block when what is still apart is compared.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1_000_000

#: Odd multipliers and shifts of a 64-bit mixing function (fixed values).
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each value."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; holds the words met first up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000 and len(word) <= 64:
            self[word] = h
        return h


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of `words` words, or of all words if there are fewer. A-Z count as a-z."""
    held = word_hashes()
    split = [t.lower().split() for t in texts]  # of bytes: ASCII letters, and the six white-space characters
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((held[w] for ws in split for w in ws), np.uint64, int(n.sum()))
    runs = flat * np.uint64(1)
    for k in range(1, words):
        stop = max(0, len(flat) - k)  # a slice may hold fewer words than a shingle
        runs[:stop] = mixed(runs[:stop] + STEP) + flat[k:]
    runs = mixed(runs)
    out, at = [], 0
    for k in n.tolist():
        if k >= words:
            out.append(np.unique(runs[at : at + k - words + 1]))
        elif k:
            h = np.full(1, k, np.uint64)
            for w in range(at, at + k):
                h = mixed(h) + flat[w : w + 1]
            out.append(mixed(h))
        else:
            out.append(flat[:0])
        at += k
    return out


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row for each set, none of them empty; `coordinates` is a power of two, 128 at most."""
    bits = coordinates.bit_length() - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full((len(sets), coordinates), empty)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    rows, values = np.repeat(np.arange(len(sets)), n), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * coordinates):
        z = mixed(values + (np.full(1, i + 1, np.uint64) * STEP))
        # the round stands above the hash, so an earlier round is always smaller
        value = (np.uint64(i) << np.uint64(56)) | (z & np.uint64((1 << 56) - 1))
        bins = (z >> np.uint64(64 - bits)).astype(np.int64) if i < coordinates else np.full(len(z), i - coordinates)
        np.minimum.at(sketch.reshape(-1), rows * coordinates + bins, value)
        open_rows = (sketch == empty).any(axis=1)
        if not open_rows.any():
            break
        keep = open_rows[rows]
        rows, values = rows[keep], values[keep]
    return sketch


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key for each band; the band's number is part of it."""
    wide = sketch.reshape(len(sketch), bands, sketch.shape[1] // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, wide.shape[:2]).copy()
    for k in range(wide.shape[2]):
        key = mixed(key + wide[:, :, k])
    return key.view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, null if empty), bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            keys = iter(band_keys(sketches([s for s in sets if len(s)])).tolist())
            columns = [
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    ship(docs.sparkSession)
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(sketch, f"doc_id {id_type}, n_shingles long, node binary, bands array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes, as bytes) for each row."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return docs.select(text_of(docs).alias("text")).mapInArrow(shingle, "node binary, shingles binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) for the pairs (a, b), on their full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left"):
            said = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                said.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(said)], ["a", "b", "linked"])

    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    return pairs.join(side("a", "left").hint("merge"), "a").join(side("b", "right").hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(verify, "a binary, b binary, linked boolean")


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, set_id (digest of the set).

    Documents are linked if their sets' intersection is at least `percent` hundredths of the union; component_id is the smallest
    doc_id that links reach. A null or empty text has no shingles, is linked with nothing and stays. Repeated rows and equal
    texts are one class. A null doc_id is larger than any other: a component of such rows alone has a null id and all of it
    stays. Only doc_id and text are read. Very long texts are sketched whole. An empty table gives an empty result.
    """
    rows = stored(sketched(docs), "sketches")
    some = rows.where("node IS NOT NULL")  # rows without words meet no join: their null nodes would be one key
    # documents of one set are merged before they are dealt out, so many copies are one small row for each task
    classes = stored(some.groupBy("node").agg(F.min("doc_id").alias("smallest")), "classes")
    sets_bands = some.select("node", F.col("n_shingles").alias("n"), "bands").distinct()
    members = stored(sets_bands.select("node", "n", F.explode("bands").alias("band")), "bands")
    order = F.xxhash64("node")
    first = members.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("one"), F.min(F.struct(order, "node", "n")).alias("other")).where("size > 1").drop("size")
    buckets = stored(members.join(first.hint("merge"), "band"), "buckets")

    wanted = buckets.select("node").distinct()
    holders = stored(classes.join(wanted.hint("merge"), "node").select(F.col("smallest").alias(f"{P}doc")).distinct(), "holders")
    held = Filter(holders, f"{P}doc").may_hold(docs.select("doc_id", "text"), "doc_id")  # other texts do not move
    held = held.join(holders.hint("merge"), held["doc_id"].eqNullSafe(F.col(f"{P}doc")), "left_semi")
    sets = stored(shingled(held).join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "sets")  # a doc_id may have several texts

    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    to = lambda leader: buckets.where((F.col("node") != F.col(f"{leader}.node")) & fits(F.col("n"), F.col(f"{leader}.n"))).select(F.least("node", f"{leader}.node").alias("a"), F.greatest("node", f"{leader}.node").alias("b"))
    links = stored(linked(to("one").union(to("other")).distinct(), sets, percent).where("linked").select("a", "b"), "links")
    found = stored(across(_apart(buckets, components(links)), sets, percent), "links")
    roots = components(links.union(found))

    # only what is linked is looked at again: the smallest doc_id of each component, then of each node
    tied = stored(classes.join(roots.hint("merge"), "node"), "tied")
    tops = tied.groupBy("root").agg(F.min("smallest").alias("top"))
    tops = tied.select("node", "root").join(tops.hint("merge"), "root").select("node", "top", F.lit(True).alias("tied"))
    reached = classes.join(tops.hint("merge"), "node", "left").select("node", F.when(F.col("tied"), F.col("top")).otherwise(F.col("smallest")).alias("component_id"))
    reached = stored(reached, "components-of-sets")  # so that the join below can split a set that many documents have
    columns = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.hex("node").alias("set_id")]
    full = some.select("doc_id", "n_shingles", "node").join(reached.hint("merge"), "node")
    none = rows.where("node IS NULL").withColumn("component_id", F.col("doc_id"))
    return full.select(*columns).unionByName(none.select(*columns))


def _apart(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, n, root): the members of buckets that hold more than one component, without the leaders, which are compared with all."""
    rest = buckets.where((F.col("node") != F.col("one.node")) & (F.col("node") != F.col("other.node"))).select("band", "node", "n")
    rooted = rest.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return stored(rooted.join(several.select("band").hint("merge"), "band", "left_semi"), "apart")


def across(apart: DataFrame, sets: DataFrame, percent: int = PERCENT, most: int = BLOCK_NODES, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that tie together what is still apart, enough of them to connect all that is linked and shares a bucket.

    In a bucket everything outside its largest component is compared with all of it, block against block: a task holds two
    blocks (of about `most` nodes or so many shingles) and gives back, for each of the one's nodes, a link to every component
    that it meets. Pairs are never rows. Of buckets with the same members one is enough.
    """
    member = apart.select(F.col("band").alias("cluster"), "node", "n", "root")
    marks = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    chosen = member.groupBy("cluster").agg(*marks).groupBy("m", "x", "y").agg(F.min("cluster").alias("cluster")).select("cluster")
    member = stored(member.join(chosen.hint("merge"), "cluster", "left_semi"), "clusters")
    sizes = member.groupBy("cluster", "root").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    facts = sizes.groupBy("cluster").agg(F.max(F.struct("m", "root")).alias("largest"), F.sum("m").alias("m"), F.sum("all").alias("all"))
    blocks = lambda m, n: F.greatest(F.ceil(m / most), F.ceil(n / shingles), F.lit(1)).cast("int")
    facts = facts.select("cluster", F.col("largest.root").alias("main"), blocks(F.col("m"), F.col("all")).alias("n_blocks"))
    placed = member.join(facts.hint("merge"), "cluster").join(sets.hint("merge"), "node").withColumns({"block": F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"), "outside": F.col("root") != F.col("main")})
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    columns = ["node", "root", "shingles"]
    left = placed.where("outside").select("cluster", F.col("block").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("asks"), *columns)
    right = placed.select("cluster", F.explode(every).alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), *columns)

    def answer(asks: list, held: list) -> list[tuple[bytes, bytes]]:
        if not asks or not held:
            return []
        sizes = np.array([len(x[2]) for x in held])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate([x[2] for x in held])
        out = []
        for node, root, own in asks:
            at = np.searchsorted(own, flat)
            both = np.add.reduceat(own[np.minimum(at, len(own) - 1)] == flat, starts, dtype=np.int64)
            hits = np.flatnonzero(100 * both >= percent * (len(own) + sizes - both))
            met = {held[h][1]: held[h][0] for h in hits if held[h][1] != root}
            out += [(node, other) for other in met.values()]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asks, held = None, [], []
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])
        for batch in slices(batches, "shingles"):
            for cluster, i, j, own, node, root, shingles_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, i, j) != key:
                    yield batch_of(answer(asks, held))
                    key, asks, held = (cluster, i, j), [], []
                (asks if own else held).append((node, root, np.frombuffer(shingles_, np.uint64)))
        yield batch_of(answer(asks, held))

    both = left.union(right).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return both.mapInArrow(compare, "a binary, b binary")
