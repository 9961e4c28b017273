"""Operator 13, spelling variants: words that one edit apart stand beside far more frequent ones, found without listing pairs.

Replacements: a word of n letters belongs to n wildcard groups (length, position, what is before, what is after). Of a group only its size and its two best words matter:
each member is near size - 1 words by that position, and its best is the first or, for the first itself, the second. Indels: the deletions of a word join the
vocabulary; a deletion that is a word is near all words it comes from, of which again only number and best are kept, and each of these is near it. The
parts are summed by word. A group holds as many words as there are letters to put in one place, however large the corpus.

Words of up to LONG code points stand in keys as they are. Of longer ones, whose deletions would take the square of their length, keys hold two
61-bit polynomial hashes of what is before and after; a deletion told that way is compared with the word itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import P, ship, stored, text_of
from tracewright.llm.word_encoder import slices

#: ASCII letters, and U+00C0 to U+00FF, in UTF-8.
RUN = rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+"
LEAST, OFTEN, TIMES, TYPO = 7, 2, 10, 31
LONG = 64
#: Words that a task counts before it passes its counts on.
HELD = 200_000
KEY, WORD, OWN = f"{P}key", f"{P}word", f"{P}own"
#: Of the hashes of long words: a prime, and two bases.
PRIME, BASES = 2**61 - 1, (1_000_003_237, 1_442_695_040_889)


def spelled(doc_id: str | None, run: bytes, every: int = TYPO) -> bytes:
    """The run, without one of its code points where `every` divides its hash. Without a doc_id there is no hash."""
    if doc_id is None or (h := zlib.crc32(run, zlib.crc32(f"{doc_id}:".encode()))) % every:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def words(docs: DataFrame, every: int = TYPO) -> DataFrame:
    """(WORD, n): the words of all texts, with counts by parts of a task."""
    found = re.compile(RUN).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], [WORD, "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                begun = doc_id is not None and zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(found(text.lower())).items():  # bytes: A-Z alone change
                    if begun is not False and zlib.crc32(run, begun) % every == 0:
                        run = spelled(doc_id, run, every)
                    held[run] += n
            if len(held) > HELD:
                yield told()
        yield told()

    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("string").alias("id"), text_of(docs).alias("text")).mapInArrow(count, f"{WORD} string, n long")


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    return words(docs).groupBy(WORD).agg(F.sum("n").alias("n")).where((F.length(WORD) >= least) & (F.col("n") >= often))


def _sums(text: str) -> tuple[list[list[int]], list[list[int]]]:
    """For both bases the hashes of all that stands before each place, and the powers of the base."""
    sums, powers = [], []
    for base in BASES:
        s, p = [0], [1]
        for c in text:
            s.append((s[-1] * base + ord(c) + 1) % PRIME)
            p.append(p[-1] * base % PRIME)
        sums.append(s)
        powers.append(p)
    return sums, powers


def long_keys(words: DataFrame) -> DataFrame:
    """(KEY, WORD, n, at) of long words: at is null for wildcard groups, the place of the letter that goes for deletions, -1 for the word itself."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, (sums, powers) = len(word), _sums(word)
                cut = lambda k, a, b, sums=sums, powers=powers: (sums[k][b] - sums[k][a] * powers[k][b - a]) % PRIME
                part = lambda a, b, cut=cut: f"{cut(0, a, b)}.{cut(1, a, b)}"
                less = lambda i, size=size, cut=cut, powers=powers: ".".join(str((cut(k, 0, i) * powers[k][size - i - 1] + cut(k, i + 1, size)) % PRIME) for k in (0, 1))
                out = [(f"d {size} {part(0, size)}", -1)]
                out += [(f"r {size} {i} {part(0, i)} {part(i + 1, size)}", None) for i in range(size)]
                # of letters that repeat side by side the first goes
                firsts = [i for i in range(size) if not i or word[i] != word[i - 1]]
                out += [(f"d {size - 1} {less(i)}" if size - 1 > LONG else f"d {word[:i]}{word[i + 1:]}", i) for i in firsts]
                for k in range(0, len(out), 4096):
                    some = out[k : k + 4096]
                    columns = [pa.array([x for x, _ in some]), pa.array([word] * len(some)), pa.array([n] * len(some), pa.int64()), pa.array([x for _, x in some], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [KEY, WORD, "n", "at"])

    ship(words.sparkSession)
    return words.select(WORD, "n").mapInArrow(keys, f"{KEY} string, {WORD} string, n long, at int")


def keyed(words: DataFrame) -> DataFrame:
    """(KEY, WORD, n, at) of all words, as long_keys gives it."""
    short = words.where(F.length(WORD) <= LONG)
    places = F.sequence(F.lit(0), F.length(WORD) - 1)
    before, after = lambda i: F.substring(F.col(WORD), F.lit(1), i), lambda i: F.substring(F.col(WORD), i + 2, F.length(WORD))
    key = lambda kind, i, *x: F.struct(F.concat_ws(" ", F.lit(kind), *x).alias("key"), i.alias("at"))
    none = F.lit(None).cast("int")
    whole = F.array(key("d", F.lit(-1), F.col(WORD)))
    # a blank stands in no word: the place of what is missing
    groups = F.transform(places, lambda i: key("r", none, F.concat(before(i), F.lit("_"), after(i))))
    firsts = F.filter(places, lambda i: (i == 0) | (F.substring(F.col(WORD), i + 1, F.lit(1)) != F.substring(F.col(WORD), i, F.lit(1))))
    deleted = F.transform(firsts, lambda i: key("d", i, F.concat(before(i), after(i))))
    rows = short.select(WORD, "n", F.explode(F.concat(whole, groups, deleted)).alias("k"))
    return rows.select(F.col("k.key").alias(KEY), WORD, "n", F.col("k.at").alias("at")).unionByName(long_keys(words.where(F.length(WORD) > LONG)))


def near(words: DataFrame) -> DataFrame:
    """(WORD, n_near, best): for the words that have any, how many are near, and the best, a struct (n negated, word)."""
    rank = lambda word, n: F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))
    rows = keyed(words)
    # one exchange for both: letters bound a group of either kind
    group, order = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy(F.col("at").isNull().desc(), F.desc("n"), WORD)
    gone = F.concat(F.substring(F.col(WORD), F.lit(1), F.col("at")), F.substring(F.col(WORD), F.col("at") + 2, F.length(WORD)))
    told = rows.withColumns({
        "size": F.count("*").over(group),
        "first": F.first(rank(WORD, "n")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "second": F.nth_value(rank(WORD, "n"), 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        OWN: F.max(F.when(F.col("at") == -1, rank(WORD, "n"))).over(group),
    })
    best = F.when(F.col("first.word") == F.col(WORD), F.col("second")).otherwise(F.col("first"))
    # a deletion that is a word: each is near the other
    indel = (F.col("at") >= 0) & (F.length(f"{OWN}.word") == F.length(WORD) - 1) & (gone == F.col(f"{OWN}.word"))
    part = lambda word, n, best: F.struct(F.col(word).alias("word"), n.cast("long").alias("n_near"), best.alias("best"))
    parts = F.when(F.col("at").isNull(), F.array(part(WORD, F.col("size") - 1, best))).when(indel, F.array(part(WORD, F.lit(1), F.col(OWN)), part(f"{OWN}.word", F.lit(1), rank(WORD, "n"))))
    each = told.where("size > 1").select(F.explode(parts).alias("p"))
    return each.groupBy(F.col("p.word").alias(WORD)).agg(F.sum("p.n_near").alias("n_near"), F.min("p.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(WORD, root) of forms (WORD, form): where following them ends. A form is many times as frequent, so chains are as long as a count has digits; each round doubles the step."""
    step = stored(forms.select(WORD, F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not step.where("moved").isEmpty():
        on = step.select(F.col(WORD).alias(f"{P}from"), F.col("root").alias(f"{P}to"))
        further = step.join(on.hint("merge"), F.col("root") == F.col(f"{P}from"), "left")
        step = stored(further.select(WORD, F.coalesce(f"{P}to", "root").alias("root"), F.col(f"{P}to").isNotNull().alias("moved")), "forms")
    return step.drop("moved")


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of at least `least` code points that stands at least `often` times.

    Words are the runs of letters of whole texts, A-Z as a-z, one code point less where the hash of doc_id and run says so (not for a null doc_id). Two
    words are near if one inserted, deleted or replaced code point makes one the other. The form is the near word of largest n, then the first in code-point order, if
    it stands at least `times` as often; else null. A null or empty text has no words; repeated rows each count; an empty table gives an empty result.
    Of docs only doc_id and text are read. A very long text is read as a whole, a very long word compared as a whole.
    """
    held = stored(vocabulary(docs, least, often), "vocabulary")
    met = near(held)
    told = held.join(met.withColumnRenamed(WORD, f"{P}near").hint("merge"), F.col(WORD) == F.col(f"{P}near"), "left")
    form = -F.col("best.n") >= times * F.col("n")
    told = stored(told.select(WORD, "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n")), "near-words")
    ends = roots(told.where("form IS NOT NULL")).withColumnRenamed(WORD, f"{P}from")
    out = told.join(ends.hint("merge"), F.col(WORD) == F.col(f"{P}from"), "left")
    return out.select(F.col(WORD).alias("word"), "form", F.coalesce("root", WORD).alias("root"), "n", "n_near", "form_n")
