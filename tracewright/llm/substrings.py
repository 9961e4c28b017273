"""Operator 11, substring dedup: windows of words that stand in an earlier document, found by super-k-mers.

A window is `window` consecutive words of a document; its minimiser is the least hash of a run of `run` words in it. Consecutive windows that share a
minimiser are a super-k-mer: one string of packed words, not one for each window. Only minimisers that several documents have can hold a repeated window, so first
minimisers alone are dealt out; then the super-k-mers of shared ones travel, each as one string, and equal strings become one. In a bucket, the strings of
one minimiser, windows are sorted (by a hash, and neighbours compared word by word) and each is told whether an earlier document has it. A bucket of more than `most` strings, such as the
surroundings of a passage that very many documents quote, is not held by a task: its windows become rows and are grouped as such.

Strings are told apart by themselves where they are grouped; the digests that lead back to their places are drawn anew, should two strings ever share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tracewright.llm.common import P, ship, stored, text_of
from tracewright.llm.filters import Filter
from tracewright.llm.line_dedup import DOC, MARK, ROW, _keyed, _met
from tracewright.llm.near_dedup import STEP, mixed, word_hashes
from tracewright.llm.word_encoder import slices

WINDOW, RUN = 50, 8
#: Strings of a bucket that a task holds at most; words that it sorts at once.
MOST, AT_ONCE = 4096, 1_000_000
START, COUNT, MINIMISER, DIGEST, BODY, SPANS, FIRST, LAST, KINDS = (f"{P}{x}" for x in ("start", "count", "minimiser", "digest", "body", "spans", "first", "last", "kinds"))
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def runs_of(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` values side by side."""
    out = mixed(flat + STEP)
    for k in range(1, size):
        out = mixed(out[:-1] + STEP) + flat[k:] if len(out) > 1 else out[:0]
    return mixed(out)


def lowest(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` values side by side."""
    span = 1
    while span * 2 <= size:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def super_kmers(texts: list[bytes], window: int, run: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser) of the super-k-mers of all texts; places count words from 0."""
    held = word_hashes()
    split = [t.split() for t in texts]  # of bytes: the six white-space characters
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((held[w] for ws in split for w in ws), np.uint64, int(n.sum()))
    if len(flat) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = lowest(runs_of(flat, run), window - run + 1)
    text, begin = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(np.arange(len(least)) + window <= (begin + n[text])[: len(least)])  # windows that end within their text
    text, least = text[at], least[at]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - first) % (window - run + 1) == 0  # where words repeat for long, no string gets long
    first = np.flatnonzero(new)
    return text[first], at[first] - begin[at[first]], np.diff(np.append(first, len(at))), least[first]


def minimisers(keyed: DataFrame, window: int, run: int) -> DataFrame:
    """(ROW, START, COUNT, MINIMISER): a row for each super-k-mer."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, start, count, least = super_kmers(batch.column("text").cast(pa.binary()).to_pylist(), window, run)
            own = [batch.column(c).take(pa.array(text)) for c in ROW]
            yield pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least.view(np.int64))], [*ROW, START, COUNT, MINIMISER])

    ship(keyed.sparkSession)
    kind = keyed.schema[DOC].dataType.simpleString()
    return keyed.select(*ROW, text_of(keyed).alias("text")).mapInArrow(find, f"{DOC} {kind}, {MARK} long, {START} int, {COUNT} int, {MINIMISER} long")


def strings(held: DataFrame, window: int, seed: int, body: bool) -> DataFrame:
    """(ROW, START, COUNT, MINIMISER, DIGEST and, if asked for, BODY) of the super-k-mers listed in SPANS."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            lists = batch.column(3)
            one = lists.flatten()
            start, count = (one.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            out, at = [], 0
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                words = text.split()
                while at < len(rows) and rows[at] == row:
                    out.append(b" ".join(words[start[at] : start[at] + count[at] + window - 1]))
                    at += 1
            told = [hashlib.blake2b(x, digest_size=16, salt=seed.to_bytes(4, "big")).digest() for x in out]
            columns = [*[batch.column(k).take(pa.array(rows)) for k in (0, 1)], *[one.field(k) for k in (0, 1, 2)], pa.array(told, pa.binary())]
            names = [*ROW, START, COUNT, MINIMISER, DIGEST]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*names, BODY]) if body else pa.RecordBatch.from_arrays(columns, names)

    kind = held.schema[DOC].dataType.simpleString()
    schema = f"{DOC} {kind}, {MARK} long, {START} int, {COUNT} int, {MINIMISER} long, {DIGEST} binary" + f", {BODY} binary" * body
    return held.select(*ROW, text_of(held).alias("text"), SPANS).mapInArrow(cut, schema)


def _later(bodies: list[bytes], bucket: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first, last): the stretches of windows of each body that a body of the same bucket and smaller rank has too. Bodies stand in the order of bucket and rank."""
    ids: dict[bytes, int] = {}
    split = [b.split(b" ") for b in bodies]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(n.sum()))
    body = np.repeat(np.arange(len(n)), n - window + 1)
    begin = (np.cumsum(n) - n)[body]
    start = begin + np.arange(len(body)) - (np.cumsum(n - window + 1) - (n - window + 1))[body]
    hashes = mixed(runs_of(flat.view(np.uint64), window)[start] + mixed(bucket[body].astype(np.uint64) + STEP))
    order = np.argsort(hashes, kind="stable")
    alike = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    same = np.zeros(len(order), bool)  # as the one before in the order
    words = np.arange(window)
    unlike = False
    for k in range(0, len(alike), 20_000):
        a, b = order[alike[k : k + 20_000]], order[alike[k : k + 20_000] + 1]
        equal = (bucket[body[a]] == bucket[body[b]]) & (flat[start[a][:, None] + words] == flat[start[b][:, None] + words]).all(axis=1)
        same[alike[k : k + 20_000] + 1] = equal
        unlike |= not equal.all()
    if unlike:  # hashes met by chance: sort the windows themselves
        whole = np.column_stack([bucket[body], *[flat[start + w] for w in words]])
        order = np.lexsort(whole.T[::-1])
        same = np.append(False, (whole[order][1:] == whole[order][:-1]).all(axis=1))
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = rank[body[order]] > rank[body[order[lead]]]
    at = np.flatnonzero(later)
    cuts = np.ones(len(at), bool)
    cuts[1:] = (np.diff(at) != 1) | (body[at][1:] != body[at][:-1])
    first = np.flatnonzero(cuts)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    offset = start - begin
    return body[at[first]], offset[at[first]], offset[at[last]]


def in_buckets(distinct: DataFrame, window: int) -> DataFrame:
    """(DIGEST, DOC, a, b): the stretches of windows of each string that an earlier document's string of its bucket has; DOC is the string's own first document."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, empty = [], 0, None

        def told(table: pa.Table) -> pa.RecordBatch:
            bucket = table.column(0).combine_chunks().to_numpy()
            doc = table.column(1).combine_chunks().dictionary_encode()
            own = doc.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.append(True, (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1]))
            number = np.cumsum(np.append(True, bucket[1:] != bucket[:-1]))
            body, a, b = _later(table.column(3).to_pylist(), number, np.cumsum(new), window)
            columns = [table.column(k).combine_chunks().take(pa.array(body)) for k in (2, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], [DIGEST, DOC, "a", "b"])

        for batch in slices(batches, BODY, rows=4096):
            if not batch.num_rows:
                continue
            empty = batch.slice(0, 0)
            parts.append(batch)
            size += batch.column(3).get_total_buffer_size() // 7
            if size >= AT_ONCE:  # up to the bucket that may go on
                table = pa.Table.from_batches(parts)
                bucket = table.column(0).combine_chunks().to_numpy()
                stop = int(np.searchsorted(bucket, bucket[-1]))
                if stop:
                    yield told(table.slice(0, stop))
                parts, size = table.slice(stop).to_batches(), 0
        if parts and empty is not None:
            yield told(pa.Table.from_batches(parts))

    kind = distinct.schema[DOC].dataType.simpleString()
    dealt = distinct.select(MINIMISER, DOC, DIGEST, BODY).repartition(MINIMISER).sortWithinPartitions(F.col(MINIMISER), F.asc_nulls_last(DOC))
    return dealt.mapInArrow(sort, f"{DIGEST} binary, {DOC} {kind}, a int, b int")


def as_rows(distinct: DataFrame, window: int) -> DataFrame:
    """What in_buckets gives, for buckets that no task should hold: each window a row."""
    words = F.split(F.col(BODY).cast("string"), " ")
    each = F.transform(F.sequence(F.lit(0), F.size(f"{P}words") - window), lambda a: F.struct(a.alias("a"), F.array_join(F.slice(f"{P}words", a + 1, window), " ").alias("words")))
    rows = stored(distinct.withColumn(f"{P}words", words).select(DIGEST, DOC, F.explode(each).alias("w")).select(DIGEST, DOC, "w.*"), "windows")
    firsts = rows.groupBy("words").agg(F.min(DOC).alias(FIRST), F.max(DOC).alias(LAST), F.count_if(F.col(DOC).isNull()).alias("unknown"))
    firsts = stored(firsts.where(f"{FIRST} <> {LAST} OR unknown > 0 AND {FIRST} IS NOT NULL").select("words", FIRST), "first-windows")
    return rows.join(firsts.hint("merge"), "words").where(~F.col(DOC).eqNullSafe(F.col(FIRST))).select(DIGEST, DOC, "a", F.col("a").alias("b"))


def repeated(docs: DataFrame, window: int = WINDOW, run: int = RUN, most: int = MOST) -> DataFrame:
    """(ROW, SPANS): for the rows of docs (with ROW) that have any, the stretches of words (from 0, both ends in) covered by windows that an earlier document has; they may overlap."""
    found = stored(minimisers(docs, window, run), "super-k-mers")
    shared = found.groupBy(MINIMISER).agg(F.min(DOC).alias(FIRST), F.max(DOC).alias(LAST), F.count_if(F.col(DOC).isNull()).alias("unknown"))
    several = f"{FIRST} <> {LAST} OR unknown > 0 AND {FIRST} IS NOT NULL"
    shared = stored(shared.where(several).select(MINIMISER), "shared-minimisers")
    hits = Filter(shared, MINIMISER).may_hold(found, MINIMISER).join(shared.hint("merge"), MINIMISER, "left_semi")
    listed = hits.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct(START, COUNT, MINIMISER))).alias(SPANS))
    met, _ = _met(docs.select(*ROW, text_of(docs).alias("text")), stored(listed, "listed"))
    met = stored(met.where(F.col(SPANS).isNotNull()), "shared-texts")

    seed = 0
    while True:
        groups = strings(met, window, seed, True).groupBy(MINIMISER, DIGEST, BODY)
        distinct = stored(groups.agg(F.min(DOC).alias(DOC), F.max(DOC).alias(LAST), F.count_if(F.col(DOC).isNull()).alias("unknown")), "strings")
        if distinct.groupBy(DIGEST).count().where("count > 1").isEmpty():
            break
        seed += 1
    places = stored(strings(met, window, seed, False).drop(MINIMISER), "places")

    # a bucket of one string has no more to tell
    kinds = stored(distinct.groupBy(MINIMISER).agg(F.count("*").alias(KINDS)).where(f"{KINDS} > 1"), "kinds")
    large = stored(kinds.where(F.col(KINDS) > most).select(MINIMISER), "large-buckets")
    told = Filter(large, MINIMISER).marked(Filter(kinds, MINIMISER).may_hold(distinct, MINIMISER), f"{P}large", MINIMISER)
    later = in_buckets(told.where(f"NOT {P}large"), window)
    if not large.isEmpty():
        later = later.unionByName(as_rows(told.where(f"{P}large"), window))
    later = stored(later, "later-windows")

    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")).alias("span")
    copied = distinct.where(f"{DOC} <> {LAST} OR unknown > 0 AND {DOC} IS NOT NULL").select(F.col(DIGEST).alias(f"{P}other"), F.col(DOC).alias(FIRST))
    copied = places.join(stored(copied, "copied").hint("merge"), F.col(DIGEST) == F.col(f"{P}other")).where(~F.col(DOC).eqNullSafe(F.col(FIRST)))
    copied = copied.select(*ROW, span(F.col(START), F.col(START) + F.col(COUNT) + window - 2))
    own = later.withColumnsRenamed({DIGEST: f"{P}other", DOC: FIRST})
    inside = places.join(own.hint("merge"), (F.col(DIGEST) == F.col(f"{P}other")) & F.col(DOC).eqNullSafe(F.col(FIRST)))
    inside = inside.select(*ROW, span(F.col(START) + F.col("a"), F.col(START) + F.col("b") + window - 1))
    return stored(copied.unionByName(inside).groupBy(*ROW).agg(F.collect_list("span").alias(SPANS)), "spans")


def substring_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, most: int = MOST) -> DataFrame:
    """docs without the words that a window covers whose word sequence also starts in a document of smaller doc_id: its columns, text changed to the kept words
    with a space between, and n_words, n_removed (long) and removed (array of first and last word, from 0), which replace columns so named.

    Windows are judged on the input. A document does not repeat itself, nor do rows that share a doc_id; rows that repeat doc_id and text lose the same words.
    A null doc_id is larger than any other, and equal to other null ones. A null text has no words and becomes empty; texts of fewer words than a window stay. A very long text is cut as a whole. An
    empty table stays empty.
    """
    ship(docs.sparkSession)
    keyed = _keyed(docs)
    met, others = _met(keyed, repeated(keyed, window, run, most))
    new = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(SPAN))]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    names, at = [f.name for f in kept], [f.name for f in kept].index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, texts, said = batch.column(len(names)), [], []
            for k, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                pairs = []
                if spans[k].is_valid:
                    one = spans[k].values
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, one.field(0).to_numpy(), 1)
                    np.add.at(depth, one.field(1).to_numpy() + 1, -1)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(depth[:-1]) > 0, [0]])))
                    pairs = [{"start": a, "end": b - 1} for a, b in edges.reshape(-1, 2).tolist()]
                texts.append(b" ".join(w for a, b in zip([0, *[p["end"] + 1 for p in pairs]], [*[p["start"] for p in pairs], len(words)], strict=True) for w in words[a:b]))
                said.append((len(words), sum(p["end"] - p["start"] + 1 for p in pairs), pairs))
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            told = [pa.array([s[0] for s in said], pa.int64()), pa.array([s[1] for s in said], pa.int64()), pa.array([s[2] for s in said], pair)]
            yield pa.RecordBatch.from_arrays([*columns, *told], [*names, *[f.name for f in new]])

    schema = StructType([*kept, *new])
    none = others.withColumn(SPANS, F.lit(None).cast(ArrayType(SPAN)))
    every = met.select(*names, SPANS).unionByName(none.select(*names, SPANS))
    return every.mapInArrow(rewrite, schema)
