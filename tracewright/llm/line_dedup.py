"""Operator 9, line dedup: content-defined chunks of lines, and passages that no chunk holds as a whole.

Lines: a line ends at a line end, and after a sentence within it, so a paragraph that is written in one line has lines too. Chunks: a rolling hash
over the hashes of the last `window` lines ends a chunk where it is 0 modulo `divisor`, so boundaries depend on nearby lines alone and
a passage that is shifted or set in another text is cut alike. Chunks of several lines that repeat anywhere in the corpus are removed but
for the first (smallest doc_id, then position), after their lines have been compared with the first one's.

Only digests of chunks are shuffled for all chunks. Repeated ones make a filter (see filters.py), and filters tell which texts must move at
all; in these the chunks are found again by the places of their lines.

Passages: a chunk begins in one text and ends in another, so a passage loses its middle. `passage_dedup` then removes every run of at least PASSAGE
words that stands earlier in the corpus. Runs of RUN words that begin with a word whose hash is 0 modulo EVERY are anchors, and all runs
where no such word is near, so equal passages have equal anchors. Around anchors that repeat, the passages that have an anchor as their first are one string of words; equal strings are one,
and only where an anchor has several strings are windows told one by one, as stretches that are then compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import BLANKS, P, WORD, stored, text_of, with_text
from tracewright.llm.filters import Filter

WINDOW, DIVISOR = 2, 2
HASH_SPACE = 2**32
FACTOR = 1_000_003  # times any hash below 2**32 this stays within a long
#: A line with its end: all up to a line end, up to a full stop, question or exclamation mark before a space and with it, or to the end of the text.
LINE = r"[^\n.!?]*+(?:[.!?](?! )[^\n.!?]*+)*+(?:\n|[.!?] )|[^\n.!?]++(?:[.!?](?! )[^\n.!?]*+)*+|[.!?]++[^\n.!?]*+(?:[.!?](?! )[^\n.!?]*+)*+"

DOC, MARK, POS, DIGEST, FIRST, GONE, LINES, CHUNKS, HITS = (f"{P}{x}" for x in ("doc", "mark", "pos", "digest", "first", "gone", "lines", "chunks", "hits"))
#: A row by its doc_id and a hash of its text.
ROW = (DOC, MARK)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def lines_of(text: Column) -> Column:
    """The lines, with the line end or space that follows; joined they are the text. An empty text is one line."""
    return _bound(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda lines: F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def bare(line: Column) -> Column:
    """The line as it is compared."""
    return F.btrim(line, F.lit(BLANKS))


def chunked(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """docs with LINES (array of lines) and CHUNKS, array<struct<first int, lines int, body string>>: the place of its first line from 1, their number, and the bare lines.

    Each step is a column of its own: an array that a lambda looks into must not be computed anew for every element.
    """

    def rolled(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            total = (total * FACTOR + F.get(f"{P}hash", i - back)) % HASH_SPACE
        return total

    # at a boundary (null until the window is full), and at the end of the text
    ends = lambda i: F.coalesce(F.shiftright(rolled(i), 7) % divisor == 0, F.lit(False)) | (i == F.size(LINES) - 1)
    before = lambda k: F.coalesce(F.get(f"{P}stops", k - 1), F.lit(-1))
    chunk = lambda stop, k: F.struct((before(k) + 2).alias("first"), (stop - before(k)).alias("lines"), F.array_join(F.slice(f"{P}bare", before(k) + 2, stop - before(k)), "\n").alias("body"))
    return (
        docs.withColumn(LINES, lines_of(text_of(docs)))
        .withColumn(f"{P}bare", F.transform(LINES, bare))
        .withColumn(f"{P}hash", F.transform(f"{P}bare", line_hash))
        .withColumn(f"{P}stops", F.filter(F.sequence(F.lit(0), F.size(LINES) - 1), ends))
        .withColumn(CHUNKS, F.transform(f"{P}stops", chunk))
        .drop(f"{P}bare", f"{P}hash", f"{P}stops")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({DOC: docs["doc_id"], MARK: F.xxhash64(text_of(docs))})


def _place() -> Column:
    return F.struct(F.col(DOC).isNull().alias("unknown"), F.col(DOC).alias("doc"), F.col(MARK).alias("mark"), F.col(POS).alias("pos"))


def _repeated(keys: DataFrame, name: str) -> DataFrame:
    """(ROW, POS, DIGEST, FIRST) of the rows of `keys` (a stored table) whose digest stands at several places; the first place of each digest."""
    first = keys.groupBy(DIGEST).agg(F.min(_place()).alias(FIRST), F.max(_place()).alias("last")).where(F.col(FIRST) != F.col("last")).drop("last")
    first = stored(first, name)  # so that the join can split a digest of many rows
    return Filter(first, DIGEST).may_hold(keys, DIGEST).join(first.hint("merge"), DIGEST)


def _met(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs with ROW: those that `found`, a stored table with a row for each ROW, may have, joined with it, and the others."""
    told = Filter(found, *ROW).marked(docs, f"{P}met", *ROW)
    same = F.col(DOC).eqNullSafe(F.col(f"{P}doc2")) & (F.col(MARK) == F.col(f"{P}mark2"))
    held = told.where(f"{P}met").join(found.withColumnsRenamed({DOC: f"{P}doc2", MARK: f"{P}mark2"}).hint("merge"), same, "left")
    return held.drop(f"{P}met", f"{P}doc2", f"{P}mark2"), told.where(f"NOT {P}met").drop(f"{P}met")


def line_dedup(docs: DataFrame, counted: bool = True, **cut: int) -> DataFrame:
    """docs without repeated chunks: its columns, text changed (n_chars too), and, if `counted`, n_lines, removed_chunks, removed_lines (long), which replace columns so named.

    Chunks are the same if their lines are, but for white space around a line. A null text is an empty one, with one empty line, and comes back
    empty. Chunks of one line are never removed here. A null doc_id comes after all others. Rows that repeat both
    doc_id and text are alike: they keep or lose the same chunks. A document all of whose chunks repeat earlier ones stays, with
    an empty text. A very long text is cut as a whole. An empty table stays empty.
    """
    keyed = _keyed(docs)
    chunks = chunked(keyed.select(*ROW, "text"), **cut).select(*ROW, F.posexplode_outer(CHUNKS).alias(POS, "chunk"))  # outer: the filter Spark infers for an inner one would repeat the whole cutting
    told = chunks.where("chunk.lines > 1").select(*ROW, POS, "chunk.first", "chunk.lines", F.unhex(F.md5("chunk.body")).alias(DIGEST))
    keys = stored(told, "chunks")
    hit = F.struct(POS, "first", "lines", DIGEST, (_place() == F.col(FIRST)).alias("model"))
    hits = stored(_repeated(keys, "repeated-chunks").groupBy(*ROW).agg(F.array_sort(F.collect_list(hit)).alias(HITS)), "chunk-hits")
    met, others = _met(keyed, hits)
    met = stored(met, "chunk-texts")

    # the lines of each repeated chunk against those of the first
    lined = met.where(F.col(HITS).isNotNull()).select(*ROW, HITS, F.transform(lines_of(text_of(met)), bare).alias(LINES))
    body = lambda h: F.struct(*[h[c].alias(c) for c in (POS, DIGEST, "model")], F.array_join(F.slice(LINES, h["first"], h["lines"]), "\n").alias("body"))
    bodies = stored(lined.select(*ROW, F.explode_outer(F.transform(HITS, body)).alias("hit")).select(*ROW, "hit.*"), "chunk-bodies")
    models = bodies.where("model").select(DIGEST, F.col("body").alias("first_body"))
    unlike = stored(bodies.where("NOT model").join(models.hint("merge"), DIGEST).where("body <> first_body").select(*ROW, POS).distinct(), "unlike-chunks")
    spared = F.lit(False)
    if not unlike.isEmpty():  # what a digest threw together by chance
        listed = stored(unlike.groupBy(*ROW).agg(F.collect_list(POS).alias(f"{P}spared")), "spared-chunks")
        held, rest = _met(met, listed)
        met = held.unionByName(rest.withColumn(f"{P}spared", F.lit(None).cast("array<int>")))
        spared = lambda h: F.coalesce(F.array_contains(f"{P}spared", h[POS]), F.lit(False))
    gone = F.filter(F.coalesce(HITS, F.array().cast(met.schema[HITS].dataType)), lambda h: ~(h["model"] | (spared(h) if callable(spared) else spared)))
    met = met.withColumn(GONE, gone)
    some = met.where(F.size(GONE) > 0).withColumn(LINES, lines_of(text_of(met)))
    # what stands between the chunks that go, which are in the order of the text
    after = F.concat(GONE, F.array(F.struct(*[x.alias(c) for c, x in ((POS, F.lit(0)), ("first", F.size(LINES) + 1), ("lines", F.lit(0)), (DIGEST, F.lit(None).cast("binary")), ("model", F.lit(False)))])))
    before = lambda k: F.coalesce(F.get(GONE, k - 1)["first"] + F.get(GONE, k - 1)["lines"], F.lit(1))
    kept = F.flatten(F.transform(after, lambda h, k: F.slice(LINES, before(k), h["first"] - before(k))))
    counts = {"n_lines": F.size(LINES).cast("long"), "removed_chunks": F.size(GONE).cast("long"), "removed_lines": F.aggregate(GONE, F.lit(0), lambda n, h: n + h["lines"]).cast("long")}
    nothing = lambda df: {"n_lines": F.greatest(F.regexp_count(text_of(df), F.lit(LINE)), F.lit(1)).cast("long"), "removed_chunks": F.lit(0).cast("long"), "removed_lines": F.lit(0).cast("long")}
    some = with_text(some.withColumns(counts if counted else {}), F.array_join(kept, ""))
    none = lambda df: with_text(df.withColumns(nothing(df) if counted else {}), text_of(df))
    columns = [*docs.columns, *[c for c in counts if counted and c not in docs.columns]]
    return some.select(*columns).unionByName(none(met.where(F.size(GONE) == 0)).select(*columns)).unionByName(none(others).select(*columns))


#: A passage has this many words at least.
PASSAGE, RUN, EVERY = 51, 12, 8
#: So many runs begin in a passage; one of them is an anchor.
STARTS = PASSAGE - RUN + 1
NEVER = -(1 << 30)  # no place
WORDS, MARKS, SPOTS, BODY, FROM, TO, WHOLE = (f"{P}{x}" for x in ("words", "marks", "spots", "body", "from", "to", "whole"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _marked(docs: DataFrame) -> DataFrame:
    """ROW, WORDS and MARKS, array<struct<p, order, run>>: where the anchors of each text begin, from 1, in order, with their rank among others and hashes of their words; null for short texts.

    Anchors begin with a telling word, or (gap) where none begins among so many words that a passage might have no other.
    """
    telling = lambda i: F.pmod(F.xxhash64(F.element_at(WORDS, i)), F.lit(EVERY)) == 0
    last = F.size(WORDS) - RUN + 1
    # no filter on the words, and outer explosions: Spark would push a filter below what it looks at, and find the words twice
    enough = lambda x: F.when(F.size(WORDS) >= PASSAGE, x)
    found = docs.select(*ROW, *[c for c in (SPOTS,) if c in docs.columns], words_of(text_of(docs)).alias(WORDS))
    found = found.withColumn(f"{P}tells", enough(F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), last), telling), F.array(last + 1))))
    tells = F.col(f"{P}tells")
    spot = lambda p, gap: F.struct(p.alias("p"), F.lit(gap).alias("gap"))
    # from each telling word to the next, which leaves the end out
    gap = lambda t, k: F.concat(F.array(spot(t, False)), F.transform(F.sequence(t + 1, F.get(tells, k + 1) - 1), lambda p: spot(p, True)))
    each = F.flatten(F.transform(tells, lambda t, k: F.when(F.get(tells, k + 1) - t > STARTS, gap(t, k)).when(k < F.size(tells) - 1, F.array(spot(t, False))).otherwise(F.array(spot(F.lit(0), False)))))
    # as one number: those of telling words before those of gaps, then by the run
    order = lambda run, gap: F.shiftright(run, 2) + F.when(gap, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    hashed = F.transform(F.filter(each, lambda x: x["p"] > 0), lambda x: F.struct(x["p"].alias("p"), x["gap"].alias("gap"), F.xxhash64(F.slice(WORDS, x["p"], RUN)).alias("run")))
    marks = F.transform(f"{P}hashed", lambda x: F.struct(x["p"].alias("p"), order(x["run"], x["gap"]).alias("order"), x["run"].alias("run")))
    return found.withColumn(f"{P}hashed", hashed).withColumn(MARKS, marks).drop(f"{P}tells", f"{P}hashed")


def _super_words(held: DataFrame) -> DataFrame:
    """(ROW, POS, `count`, run, BODY): of the anchors listed in SPOTS (places in MARKS from 0) the passages that have it as their first by rank, then place: `count` starts from POS
    on, as one string of words. A passage has one such anchor, and equal passages the same one."""
    x0 = F.transform(SPOTS, lambda k: F.struct(k.alias("k"), *[F.get(MARKS, k)[c].alias(c) for c in ("p", "order", "run")]))
    # the nearest to either side that comes first; of equal ones the left one does
    before = lambda x: F.aggregate(F.slice(MARKS, F.greatest(x["k"] - STARTS + 2, F.lit(1)), F.least(x["k"], F.lit(STARTS - 1))), F.lit(NEVER), lambda l, m: F.when(m["order"] <= x["order"], m["p"]).otherwise(l))  # noqa: E731, E741
    after = lambda x: F.aggregate(F.slice(MARKS, x["k"] + 2, STARTS - 1), F.lit(-NEVER), lambda r, m: F.when((r == -NEVER) & (m["order"] < x["order"]), m["p"]).otherwise(r))
    near = F.transform(f"{P}own", lambda x: F.struct(x["p"].alias("p"), x["run"].alias("run"), before(x).alias("l"), after(x).alias("r")))
    first = lambda x: F.greatest(F.lit(1), x["p"] - STARTS + 1, x["l"] + 1)
    last = lambda x: F.least(x["p"], F.size(WORDS) - PASSAGE + 1, x["r"] - STARTS)
    ranges = F.filter(F.transform(f"{P}near", lambda x: F.struct(x["run"].alias("run"), first(x).alias("a"), last(x).alias("b"))), lambda x: x["a"] <= x["b"])
    strings = F.transform(f"{P}ranges", lambda x: F.struct(x["run"].alias("run"), x["a"].alias(POS), (x["b"] - x["a"] + 1).alias("count"), F.array_join(F.slice(WORDS, x["a"], x["b"] - x["a"] + PASSAGE), " ").alias(BODY)))
    told = held.withColumn(f"{P}own", x0).withColumn(f"{P}near", near).withColumn(f"{P}ranges", ranges).select(*ROW, F.explode_outer(strings).alias("x"))
    return told.where("x IS NOT NULL").select(*ROW, "x.*")


def _same(doc: Column, mark: Column) -> Column:
    return F.col(DOC).eqNullSafe(doc) & (F.col(MARK) == mark)


def _windows(bodies: DataFrame, seed: int) -> DataFrame:
    """(DIGEST, `o`, FIRST, `other`, `at`): of the windows of strings that stand in an earlier place of another string: where in theirs, the first place of all, and where in its string."""
    words = F.split(BODY, " ")
    each = F.transform(F.sequence(F.lit(0), F.size(WORDS) - PASSAGE), lambda o: F.struct(o.alias("o"), F.unhex(F.md5(F.concat(F.lit(f"{seed} "), F.array_join(F.slice(WORDS, o + 1, PASSAGE), " ")))).alias("window")))
    rows = bodies.withColumn(WORDS, words).select(DIGEST, FIRST, F.explode_outer(each).alias("w")).select(DIGEST, FIRST, "w.*")
    place = F.struct(*[(F.col(f"{FIRST}.{c}") + F.col("o") if c == "pos" else F.col(f"{FIRST}.{c}")).alias(c) for c in ("unknown", "doc", "mark", "pos")], F.col(DIGEST).alias("other"), F.col("o").alias("at"))
    rows = stored(rows.select(DIGEST, "o", "window", place.alias("place")), "windows")
    firsts = rows.groupBy("window").agg(F.min("place").alias(FIRST), F.max("place").alias("last")).where(F.col(FIRST) != F.col("last")).drop("last")
    firsts = stored(firsts, "first-windows")
    later = Filter(firsts, "window").may_hold(rows, "window").join(firsts.hint("merge"), "window").where(F.col("place") != F.col(FIRST))
    return later.select(DIGEST, "o", *[F.col(f"{FIRST}.{c}").alias(c) for c in ("unknown", "doc", "mark", "pos", "other", "at")])


def _diagonals(later: DataFrame) -> DataFrame:
    """(DIGEST, `runs`): stretches of windows of a string, from offset oa to ob, that follow one another in one first string too: its place for offset 0, and the shift to its own offsets."""
    listed = later.groupBy(DIGEST).agg(F.array_sort(F.collect_list(F.struct("o", "doc", "mark", (F.col("pos") - F.col("o")).alias("pos"), "other", (F.col("at") - F.col("o")).alias("shift")))).alias("w"))
    w = lambda k: F.get("w", k)
    alike = lambda k: (w(k)["o"] == w(k - 1)["o"] + 1) & w(k)["doc"].eqNullSafe(w(k - 1)["doc"]) & (w(k)["mark"] == w(k - 1)["mark"]) & (w(k)["pos"] == w(k - 1)["pos"]) & (w(k)["other"] == w(k - 1)["other"]) & (w(k)["shift"] == w(k - 1)["shift"])
    listed = listed.withColumn("cuts", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda k: (k == 0) | ~alike(k)))
    end = lambda i: w(F.coalesce(F.get("cuts", i + 1), F.size("w")) - 1)["o"]
    runs = F.transform("cuts", lambda k, i: F.struct(w(k)["o"].alias("oa"), end(i).alias("ob"), w(k)["doc"].alias("doc"), w(k)["mark"].alias("mark"), w(k)["pos"].alias("pos"), w(k)["other"].alias("other"), w(k)["shift"].alias("shift")))
    return listed.select(DIGEST, runs.alias("runs"))


def _spans(docs: DataFrame) -> DataFrame:
    """(ROW, `start`, `end`): the words of docs (with ROW) that go, as spans that may overlap."""
    marked = _marked(docs).select(*ROW, F.posexplode_outer(MARKS).alias("k", "m")).where("m IS NOT NULL").select(*ROW, "k", "m.run")
    anchors = stored(marked, "anchors")
    shared = stored(anchors.groupBy("run").count().where("count > 1").select("run"), "repeated-runs")
    hits = Filter(shared, "run").may_hold(anchors, "run").join(shared.hint("merge"), "run", "left_semi")
    held, _ = _met(docs.select(*ROW, "text"), stored(hits.groupBy(*ROW).agg(F.array_sort(F.collect_set("k")).alias(SPOTS)), "anchor-hits"))
    told = _super_words(_marked(held.where(F.col(SPOTS).isNotNull())))
    seed = 0
    while True:  # until digests tell all strings apart, and windows
        places = stored(told.withColumn(DIGEST, F.unhex(F.md5(F.concat(F.lit(f"{seed} "), BODY)))), "super-words")
        grouped = places.groupBy(DIGEST, "run", "count", BODY).agg(F.min(_place()).alias(FIRST), F.max(_place()).alias("last"))
        bodies = stored(grouped.withColumn(WHOLE, F.col(FIRST) != F.col("last")).drop("last"), "strings")
        if bodies.groupBy(DIGEST).count().where("count > 1").isEmpty():
            kinds = stored(bodies.groupBy("run").count().where("count > 1").select("run"), "kinds")
            runs = stored(_diagonals(_windows(Filter(kinds, "run").may_hold(bodies, "run"), seed)), "diagonals")
            part = lambda body, a, n: F.array_join(F.slice(F.split(body, " "), a + 1, n), " ")
            pairs = runs.select(DIGEST, F.inline("runs")).join(bodies.select(DIGEST, BODY).hint("merge"), DIGEST)
            pairs = pairs.join(bodies.select(F.col(DIGEST).alias("other"), F.col(BODY).alias(f"{P}first")).hint("merge"), "other")
            size = F.col("ob") - F.col("oa") + PASSAGE
            if pairs.where(part(BODY, F.col("oa"), size) != part(f"{P}first", F.col("oa") + F.col("shift"), size)).isEmpty():
                break
        seed += 1

    # every offset of a string by its first place: a stretch of another string's, or else the string's own first place
    plain = lambda oa, ob, doc, mark, pos: F.struct(oa.alias("oa"), ob.alias("ob"), doc.alias("doc"), mark.alias("mark"), pos.alias("pos"))
    own = lambda oa, ob: plain(oa, ob, F.col(f"{FIRST}.doc"), F.col(f"{FIRST}.mark"), F.col(f"{FIRST}.pos"))
    some = bodies.select(DIGEST, "count", FIRST, WHOLE).join(runs.hint("merge"), DIGEST, "left").where(F.col(WHOLE) | F.col("runs").isNotNull())
    some = some.withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))
    since, until = lambda i: F.coalesce(F.get("runs", i - 1)["ob"] + 1, F.lit(0)), lambda i: F.coalesce(F.get("runs", i)["oa"], F.col("count")) - 1
    rest = F.filter(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: own(since(i), until(i))), lambda x: x["oa"] <= x["ob"])
    others = F.transform("runs", lambda x: plain(x["oa"], x["ob"], x["doc"], x["mark"], x["pos"]))
    some = stored(some.select(DIGEST, F.concat(others, rest).alias("firsts")), "first-places")
    met = Filter(some, DIGEST).may_hold(places.select(*ROW, POS, DIGEST), DIGEST).join(some.hint("merge"), DIGEST).select(*ROW, POS, F.inline("firsts"))
    here = _same(F.col("doc"), F.col("mark"))
    start = F.col(POS) + F.col("oa")
    return met.where(~(here & (F.col("pos") == F.col(POS)))).select(*ROW, F.when(here, F.greatest(start, F.col("pos") + F.col("oa") + PASSAGE)).otherwise(start).alias("start"), (F.col(POS) + F.col("ob") + PASSAGE - 1).alias("end"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """docs without runs of PASSAGE words or more that stand earlier (by doc_id, null last, then position), wherever lines end; text and n_chars change.

    Words are compared, not the white space between them: strings of words are grouped by themselves, and a stretch that two strings share is compared as a whole, so digests decide nothing.
    A run that overlaps its own first place loses only what is beyond that. Nothing is sampled or capped. Rows that repeat doc_id and text are alike; a null text becomes
    an empty one; an empty table stays empty.
    """
    keyed = _keyed(docs)
    spans = _spans(keyed)
    # spans that touch are one
    order = Window.partitionBy(*ROW).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    numbered = opened.withColumn("n", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*ROW, "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = joined.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(GONE))
    met, others = _met(keyed, stored(merged, "passage-hits"))
    blank = r"[\x20\x09-\x0D]*"
    pieces = met.where(F.col(GONE).isNotNull()).withColumn(f"{P}pieces", F.regexp_extract_all(text_of(met), F.lit(f"(?:^{blank})?{WORD}{blank}"), F.lit(0)))
    before = lambda k: F.coalesce(F.get(GONE, k - 1)["end"], F.lit(0))
    between = F.flatten(F.transform(F.concat(GONE, F.array(F.struct((F.size(f"{P}pieces") + 1).alias("start"), F.lit(0).alias("end")))), lambda s, k: F.slice(f"{P}pieces", before(k) + 1, F.greatest(s["start"] - before(k) - 1, F.lit(0)))))
    some = with_text(pieces, F.array_join(between, ""))
    alike = lambda df: with_text(df, text_of(df)).select(*docs.columns)
    return some.select(*docs.columns).unionByName(alike(met.where(F.col(GONE).isNull()))).unionByName(alike(others))
