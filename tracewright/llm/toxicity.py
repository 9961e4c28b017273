"""Operator 3, toxicity: a convolutional text classifier.

Words are embedded by hashing: the vector of a word is the sum of the vectors of its hash and of its prefixes' hashes. Filters of
several widths slide over the whole text, the maximum of each over the text is kept, and a logistic layer scores it. The
network begins in numpy in one task, on a bounded part of the labelled documents, and then all of them are learnt from, in as many tasks as SHARDS says, whose
changes are averaged. It scores every document in full where it lies, a stretch of words at a time.
Thresholds are calibrated for each language on all labelled rows kept from training; the score itself sees the text only.
"""

from __future__ import annotations

import io
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import P, ship, stored, text_of
from tracewright.llm.word_encoder import give_back, slices

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
PREFIXES, LONGEST = (3, 4, 5), 24  # bytes of a word that are hashed as prefixes; bytes of a piece of a word
START_BYTES, STRETCH, TOGETHER = 64 << 20, 1 << 18, 1 << 17  # bytes of text that training begins with; characters of a text, and words of texts, that are scored together
START, EPOCHS, BATCH, RATE, DECAY, BLOT, SEED = 4000, 8, 32, 0.005, 1e-4, 0.3, 11
SHARDS, REFINE, BLOCK, STEPS = 64, 0.001, 1 << 12, 10_000  # tasks that go over all rows, and their rate; rows of `words` that are averaged together; steps of scores that are counted
PARTS = 16  # tasks that send a network to the driver
PRECISION, DEFAULT, LOWEST, FEWEST = 0.95, 0.5, 0.3, 5  # aim of a threshold, that of other languages, the least one, positives that one needs

#: ASCII letters and digits stand, bytes above them too; all else separates words.
SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Other white space, control characters and punctuation; characters of scripts that put no spaces between words.
PARTING = re.compile("[" + "".join(re.escape(chr(c)) for c in range(128, 0x20000) if unicodedata.category(chr(c))[0] in "ZP" or unicodedata.category(chr(c)) == "Cc" or c in (0x200B, 0xFEFF)) + "]")
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua980-\ua9df\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
PAIRS = re.compile(UNSPACED.pattern + f"(?={UNSPACED.pattern}?)")


def words_of(text: str) -> list[bytes]:
    """The words; of scripts without spaces, each character with the next. Longer words than LONGEST bytes are cut into pieces, so every byte counts."""
    text = text.lower()
    if not text.isascii():
        text = PARTING.sub(" ", text)
        if UNSPACED.search(text):
            text = PAIRS.sub(lambda m: f" {m[1]}{m[2] or ''} ", text)
    words = text.encode().translate(SEPARATE).split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def features(words: list[bytes]) -> np.ndarray:
    """A row of bucket numbers for each word: its prefixes and the word. Shorter words give the same bucket again."""
    raw = np.array(words, f"S{LONGEST}").view(np.uint8).reshape(len(words), LONGEST)
    h, out = np.full(len(words), 14695981039346656037, np.uint64), []
    for k in range(LONGEST):
        there = raw[:, k] > 0
        h = np.where(there, (h ^ raw[:, k]) * np.uint64(1099511628211), h)
        if k + 1 in PREFIXES:
            out.append(h + np.uint64(k))
    out.append(h + np.uint64(LONGEST))
    x = np.stack(out, 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Network:
    """Weights; row BUCKETS of `words` stays 0 and stands for what is beyond the ends of a text."""

    words: np.ndarray
    filters: list[np.ndarray]  # (width * SIZE, FILTERS)
    shifts: np.ndarray
    out: np.ndarray
    bias: float
    constant: float | None = None  # the score of every text, where there was nothing to learn from

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        words = np.vstack([rng.normal(0, 0.02, (BUCKETS, SIZE)), np.zeros((1, SIZE))]).astype(np.float32)
        filters = [rng.normal(0, (1 / (w * SIZE)) ** 0.5, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return Network(words, filters, np.full(n, -0.1, np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        most = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        held, owner, size = [], [], 0
        for k, text in enumerate(texts):
            for stretch in stretches(text):
                held.append(stretch)
                owner.append(k)
                size += len(stretch[0])
                if size > TOGETHER:
                    np.maximum.at(most, owner, self.pooled(held))
                    held, owner, size = [], [], 0
        if held:
            np.maximum.at(most, owner, self.pooled(held))
        z = np.maximum(most + self.shifts, 0) @ self.out + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 6)

    def pooled(self, held: list[tuple[list[bytes], int]]) -> np.ndarray:
        """The maximum of each filter over the first words of each list, as many as its number says; windows reach into the words after them."""
        distinct = list(set().union(*(ws for ws, _ in held)))
        number = {w: k for k, w in enumerate(distinct)}
        pad = len(distinct)  # the vector of 0
        gap = [pad] * (max(WIDTHS) - 1)
        flat = np.fromiter((k for ws, _ in held for part in (map(number.__getitem__, ws), gap) for k in part), np.int64)
        starts = np.cumsum([0] + [len(ws) + len(gap) for ws, _ in held[:-1]])
        bounds = np.append(np.stack([starts, starts + [own for _, own in held]], 1).reshape(-1), len(flat))
        vectors = np.zeros((pad + 1, SIZE), np.float32)
        for k in range(0, pad, 1 << 16):
            vectors[k : k + (1 << 16)][: len(distinct[k : k + (1 << 16)])] = self.words[features(distinct[k : k + (1 << 16)])].sum(1)
        most = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            total = np.zeros((len(flat) + 1, FILTERS), np.float32)
            total[:-1] = (vectors @ f[:SIZE])[flat]
            for j in range(1, width):
                total[: -j - 1] += (vectors @ f[j * SIZE : (j + 1) * SIZE])[flat[j:]]
            most.append(np.maximum.reduceat(total, bounds[:-1], axis=0)[::2])
        return np.concatenate(most, 1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=self.words, shifts=self.shifts, out=self.out, rest=np.array([self.bias, np.nan if self.constant is None else self.constant]), **{f"filter{k}": f for k, f in enumerate(self.filters)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Network:
        a = np.load(io.BytesIO(raw))
        bias, constant = a["rest"].tolist()
        return Network(a["words"], [a[f"filter{k}"] for k in range(len(WIDTHS))], a["shifts"], a["out"], bias, None if np.isnan(constant) else constant)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """The network in rows of BLOCK vectors, by their number, and at -1 all but the vectors."""
        yield -1, Network(self.words[:0], self.filters, self.shifts, self.out, self.bias, self.constant).dump()
        for k in range(0, len(self.words), BLOCK):
            yield k // BLOCK, self.words[k : k + BLOCK].tobytes()

    @staticmethod
    def joined(parts: Iterable[tuple[int, bytes]]) -> Network | None:
        """The network of these parts, in any order; none of no parts."""
        words, rest = np.zeros((BUCKETS + 1, SIZE), np.float32), None
        for block, raw in parts:
            if block < 0:
                rest = Network.load(raw)
            else:
                some = np.frombuffer(raw, np.float32).reshape(-1, SIZE)
                words[block * BLOCK : block * BLOCK + len(some)] = some
        if rest:
            rest.words = words
        return rest


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them are its own) of a text in turn, cut at white space; after its own words stand the next ones that a window reaches.

    Together they have the windows of the whole text. What follows the last word counts as its own, as in a short text.
    """
    beyond, at, before = max(WIDTHS) - 1, 0, None
    while True:
        cut = SPACE.search(text, at + size) if len(text) > at + size else None
        end = cut.start() if cut else len(text)
        words = words_of(text[at:end])
        if before is not None:
            if end < len(text) and len(words) < beyond:  # too few to tell what the windows before reach: together
                words, before = before + words, None
            else:
                yield before + words[:beyond], len(before)
        if end == len(text):
            yield words, len(words) + beyond
            return
        before, at = words, end


class Adam:
    """Steps of a network's training. Its bias goes along as an array until training ends."""

    def __init__(self, net: Network, rate: float = RATE) -> None:
        self.net, self.rate, self.step = net, rate, 0
        self.params = [net.words, *net.filters, net.shifts, net.out, np.array([net.bias], np.float32)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]

    def epoch(self, texts: list[str], labels: np.ndarray, rng: np.random.Generator, epochs: int = 1) -> None:
        net, params = self.net, self.params
        number: dict[bytes, int] = {}  # words become numbers text by text: the words of all texts at once would be most of the memory
        docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
        distinct = list(number)
        number.clear()
        table = np.vstack([features(distinct), np.full((1, len(PREFIXES) + 1), BUCKETS, np.int32)]) if distinct else np.full((1, len(PREFIXES) + 1), BUCKETS, np.int32)
        beyond = np.full(max(WIDTHS) - 1, len(distinct), np.int32)
        docs = [np.concatenate([d, beyond]) for d in docs]
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                flat, y = np.concatenate([docs[i] for i in some]), labels[some].astype(np.float32)
                starts = np.cumsum([0] + [len(docs[i]) for i in some[:-1]])
                # some words are blotted out at random, so that the network does not lean on a few of many telling ones
                flat = np.where(rng.random(len(flat)) < BLOT, len(distinct), flat)
                distinct_here, flat = np.unique(flat, return_inverse=True)
                hashed = table[distinct_here]
                vectors = net.words[hashed].sum(1)
                pooled, where = [], []
                for width, f in zip(WIDTHS, net.filters, strict=True):
                    total = (vectors @ f[:SIZE])[flat]
                    for j in range(1, width):
                        total[:-j] += (vectors @ f[j * SIZE : (j + 1) * SIZE])[flat[j:]]
                    ends = [*starts[1:], len(flat)]
                    where.append(np.stack([a + total[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
                    pooled.append(np.take_along_axis(total, where[-1], 0))
                before = np.concatenate(pooled, 1) + net.shifts
                keep = (rng.random(before.shape) < 0.8).astype(np.float32) / 0.8
                hidden = np.maximum(before, 0) * keep
                p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + params[-1][0], -30, 30)))
                dz = (p - y) / len(some)
                dh = dz[:, None] * net.out * keep * (before > 0)
                touched, backs = [], []
                grads = [None, *[np.zeros_like(f) for f in net.filters], dh.sum(0), hidden.T @ dz, np.array([dz.sum()])]
                for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        spot = np.minimum(where[k] + j, len(flat) - 1)
                        v = vectors[flat[spot]]  # (docs, FILTERS, SIZE)
                        inside = (where[k] + j < len(flat))[:, :, None]
                        part = slice(j * SIZE, (j + 1) * SIZE)
                        grads[1 + k][part] += np.einsum("dfs,df->sf", v * inside, d)
                        back = d[:, :, None] * f[part].T[None] * inside
                        touched.append(flat[spot].reshape(-1))
                        backs.append(back.reshape(-1, SIZE))
                # only the vectors of words that a maximum came from change
                rows, at_row = np.unique(hashed[np.concatenate(touched)], return_inverse=True)
                grads[0] = np.zeros((len(rows), SIZE), np.float32)
                back = np.concatenate(backs)
                for h in range(hashed.shape[1]):
                    np.add.at(grads[0], at_row.reshape(-1, hashed.shape[1])[:, h], back)
                grads[0][rows == BUCKETS] = 0
                self.step += 1
                for k, (p_, g, (m, v)) in enumerate(zip(params, grads, self.moments, strict=True)):
                    own = rows if k == 0 else slice(None)
                    g = g + DECAY * p_[own] * (p_.ndim > 1)
                    m[own] += 0.1 * (g - m[own])
                    v[own] += 0.01 * (g * g - v[own])
                    p_[own] -= self.rate * (m[own] / (1 - 0.9**self.step)) / (np.sqrt(v[own] / (1 - 0.99**self.step)) + 1e-7)


def train(texts: list[str], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the log loss; the gradient of a maximum goes to the place it came from, so the backward pass is short.

    `prior` is the share of toxic rows among all labelled ones; the sample may hold more of them, and the bias is set back for that.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if not len(labels) or labels.min() == labels.max():
        net.constant = float(prior)
        return net
    adam = Adam(net)
    adam.epoch(texts, labels, rng, epochs)
    here = labels.mean()
    net.bias = float(adam.params[-1][0] + np.log(prior / (1 - prior)) - np.log(here / (1 - here)))
    return net


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float = PRECISION, weights: np.ndarray | None = None, fallback: float = DEFAULT) -> float:
    """The least score at and above which labelled rows reach the precision; halfway down to the next lower score. `fallback` where too few are toxic."""
    if (labels if weights is None else labels * np.maximum(weights, 1)).sum() < FEWEST:
        return fallback
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    w = np.ones(len(y)) if weights is None else weights[order]
    good = np.cumsum(w * y) / np.cumsum(w) >= precision
    good &= np.append(s[:-1] != s[1:], True)  # rows of equal score go together
    if not good.any():
        return 1.0
    last = int(np.flatnonzero(good)[-1])
    return max(LOWEST, float((s[last] + (s[last + 1] if last + 1 < len(s) else 0)) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, start: int = START, start_bytes: int = START_BYTES) -> tuple[Network, dict[str, float]]:
    """A network, and a threshold for each language; '' stands for all others, for which the languages are pooled.

    All labelled rows that are not held out are learnt from: of each five, by a hash of doc_id, four to train and one to calibrate. Training begins in one task on at most
    start / 2 rows of each label and `start_bytes` of text; from that network each of SHARDS tasks at most goes over its share of all training rows, and what
    the tasks changed is averaged. Thresholds count all rows set aside. Rows without a label or doc_id do not count; a document with
    several labels is toxic if any says so, and of a repeated doc_id the smallest text counts.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    language = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    marked = usable.select(F.col("doc_id").alias(f"{P}id"), F.col("toxic").cast("int").alias("toxic"))
    one = docs.select("doc_id", text_of(docs).alias("text"), language.alias("lang")).join(marked, F.col("doc_id") == F.col(f"{P}id")).groupBy(f"{P}id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one"))
    hashed = F.xxhash64(f"{P}id")
    rows = stored(one.select(f"{P}id", "toxic", "one.text", "one.lang", hashed.alias(f"{P}hash"), (F.pmod(F.xxhash64(F.lit(SEED), f"{P}id"), F.lit(5)) == 4).alias(f"{P}aside")), "labelled")
    n = {int(r["toxic"]): r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    ours = rows.where(~F.col(f"{P}aside"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, size = [], [], 0
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                size += len(text)
                if size <= start_bytes or not texts:
                    texts.append(text)
                    y.append(toxic)
        net = train(texts, np.array(y, np.float64), prior)
        texts.clear()
        give_back()
        blocks, raw = zip(*net.parts(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(raw, pa.binary())], ["block", "raw"])

    ship(docs.sparkSession)
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(f"{P}hash", f"{P}id"))
    chosen = None
    for label in (0, 1):
        some = ours.where(F.col("toxic") == label).orderBy(f"{P}hash", f"{P}id").limit(start // 2)
        chosen = some if chosen is None else chosen.union(some)
    ordered = chosen.withColumn(f"{P}place", place).repartition(1).sortWithinPartitions(f"{P}place", "toxic", f"{P}id").select("toxic", "text")
    first = stored(ordered.mapInArrow(learn, "block int, raw binary"), "toxicity")
    net = Network.joined(fetched(first)) or train([], np.zeros(0), prior)
    if net.constant is None:
        net = refined(net, ours)
    return net, calibrated(rows.where(f"{P}aside"), net)


def fetched(parts: DataFrame) -> Iterator[tuple]:
    """The rows of a table as large as a network, at the driver: in PARTS results of tasks, each of them far below what Spark sends as a block of its own, and without
    rows of Python or of the JVM. A result as large as a network would be there in several copies at once, each of them one array."""
    for batch in parts.repartition(PARTS).toArrow().to_batches():
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_buffer() if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c[k].as_py() for c in columns)


def refined(net: Network, rows: DataFrame) -> Network:
    """The network after every row (toxic, text) was learnt from once more: each task takes the same weights over its rows, a bounded part of them at a time,
    and what tasks changed is averaged; the vector of a word over the tasks that met it."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(net)
    shards = min(SHARDS, max(1, rows.count() // START))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_ = shared.value
        own = Network(from_.words.copy(), [f.copy() for f in from_.filters], from_.shifts.copy(), from_.out.copy(), from_.bias)
        adam, rng = Adam(own, REFINE), np.random.default_rng(SEED)
        texts, y, size, met = [], [], 0, 0
        for batch in slices(batches, "text", 1024, 4 << 20):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                texts.append(text)
                y.append(toxic)
                size += len(text)
                met += 1
                if len(texts) >= START or size >= START_BYTES // 4:
                    adam.epoch(texts, np.array(y, np.float64), rng)
                    texts, y, size = [], [], 0
        if texts:
            adam.epoch(texts, np.array(y, np.float64), rng)
        if met:
            own.bias = float(adam.params[-1][0])
            rest = np.concatenate([f.reshape(-1) for f in [*own.filters, own.shifts, own.out, np.array([own.bias])]]) - np.concatenate([f.reshape(-1) for f in [*from_.filters, from_.shifts, from_.out, np.array([from_.bias])]])
            out = [(-1, met, np.zeros(0, np.int32).tobytes(), rest.astype(np.float64).tobytes())]
            moved = np.flatnonzero((own.words != from_.words).any(1)).astype(np.int32)
            for block in np.unique(moved // BLOCK).tolist():
                some = moved[moved // BLOCK == block]
                out.append((block, met, some.tobytes(), (own.words[some] - from_.words[some]).astype(np.float32).tobytes()))
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "met", "places", "moved"])

    def average(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["met", "places", "moved"])  # one order of sums, whichever task was first
        if key[0] < 0:
            all_ = np.stack([np.frombuffer(m) for m in found["moved"]])
            return pd.DataFrame({"block": [key[0]], "places": [b""], "moved": [np.average(all_, axis=0, weights=found["met"].to_numpy(float)).tobytes()]})
        total, weight = np.zeros((BLOCK, SIZE)), np.zeros((BLOCK, 1))
        for places, moved, met in zip(found["places"], found["moved"], found["met"], strict=True):
            at = np.frombuffer(places, np.int32) - key[0] * BLOCK
            total[at] += met * np.frombuffer(moved, np.float32).reshape(-1, SIZE)
            weight[at] += met
        at = np.flatnonzero(weight[:, 0]).astype(np.int32)
        return pd.DataFrame({"block": [key[0]], "places": [(at + key[0] * BLOCK).astype(np.int32).tobytes()], "moved": [(total[at] / weight[at]).astype(np.float32).tobytes()]})

    dealt = rows.repartition(shards, F.pmod(f"{P}hash", F.lit(shards))).sortWithinPartitions(f"{P}hash", f"{P}id").select("toxic", "text")
    changes = stored(dealt.mapInArrow(change, "block int, met long, places binary, moved binary"), "changes")
    out = Network(net.words.copy(), [f.copy() for f in net.filters], net.shifts.copy(), net.out.copy(), net.bias)
    for block, places, moved in fetched(changes.groupBy("block").applyInPandas(average, "block int, places binary, moved binary")):
        if block < 0:
            rest, at = np.frombuffer(moved), 0
            for f in [*out.filters, out.shifts, out.out]:
                f += rest[at : at + f.size].reshape(f.shape).astype(np.float32)
                at += f.size
            out.bias += float(rest[at])
        else:
            out.words[np.frombuffer(places, np.int32)] += np.frombuffer(moved, np.float32).reshape(-1, SIZE)
    shared.destroy()
    return out


def calibrated(aside: DataFrame, net: Network) -> dict[str, float]:
    """Thresholds by language from all rows set aside, counted by score in steps of 1 / STEPS: as many numbers as steps and languages, whatever the corpus holds."""
    shared = aside.sparkSession.sparkContext.broadcast(net)
    seen = _scored(aside.select("toxic", "text", "lang"), shared, f"{P}score").withColumn(f"{P}step", F.floor(F.col(f"{P}score") * STEPS))
    counts = seen.groupBy("lang", f"{P}step").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).collect()
    shared.destroy()
    pairs = [(r["lang"], r[f"{P}step"] / STEPS, label, k) for r in counts for label, k in ((1, r["bad"]), (0, r["all"] - r["bad"])) if k]
    s, y, w = (np.array([p[k] for p in pairs], np.float64) for k in (1, 2, 3))
    lang = np.array([p[0] for p in pairs], object)

    def of(some: np.ndarray, fallback: float) -> float:
        if (w * y)[some].sum() < FEWEST:
            return fallback
        return math.ceil(round(threshold(s[some], y[some], weights=w[some]) * STEPS, 6)) / STEPS  # where a step begins

    pooled = of(np.ones(len(pairs), bool), DEFAULT)
    return {"": pooled} | {g: of(lang == g, pooled) for g in sorted({g for g in lang if isinstance(g, str) and g})}


def scored(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """docs with a column for the score, which replaces one so named; every text is read in full."""
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(net), name)


def _scored(docs: DataFrame, shared: Broadcast, name: str) -> DataFrame:
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    kept = docs.select(*[docs[c] for c in columns])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1024, 4 << 20):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts), pa.float64())], [*batch.schema.names, name])

    return kept.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3, start: int = START) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (score >= cut), rejected (score at or above the language's threshold).

    A null text is an empty one and gets the score of an empty text. A null doc_id is not held out. Repeated rows and ties
    score alike. A language with too few toxic rows to calibrate on, or null, has the threshold of all languages together. Without labels of
    both kinds every score is the share of toxic labels (0 without any). Only doc_id, text and lang are read. An empty table gives an empty result.
    """
    net, thresholds = fit(docs, labels, start)
    language = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    rows = scored(docs.select("doc_id", text_of(docs).alias("text"), language.alias("lang")), net)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), rejected(thresholds).alias("rejected"))


def rejected(thresholds: dict[str, float], name: str = "score") -> Column:
    """Whether a score is at or above the threshold of the row's lang; a null or unknown lang has that of all languages together."""
    limit = F.lit(thresholds.get("", DEFAULT))
    for lang, t in sorted(thresholds.items()):
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return F.col(name) >= limit
