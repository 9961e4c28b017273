"""Passages of over 50 words, wherever they stand, against brute force."""

import random

import corpus_pipeline
from tracewright.llm import line_dedup


def brute(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        w, gone = text.split(), set()
        for s in range(len(w) - 50):
            j, p = seen.setdefault(tuple(w[s : s + 51]), (i, s))
            if (j, p) != (i, s):
                gone |= set(range(max(s, p + 51) if i == j else s, s + 51))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_passages_in_lines_and_over_lines(spark):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    wrap = lambda ws, n: "\n".join(" ".join(ws[k : k + n]) for k in range(0, len(ws), n))
    rows = []
    for t, (lines, n) in enumerate([(3, 20), (4, 15), (6, 10), (30, 5), (1, 51), (1, 50)]):
        passage = words(lines * n)
        rows += [(10 * t, "\n".join([wrap(words(30), 7), wrap(passage, n), wrap(words(20), 9)])), (10 * t + 1, " ".join(words(35) + passage + words(5))), (10 * t + 2, wrap(passage[3:], 8))]
    rows += [(90, " ".join(["a", "b"] * 90)), (91, "a b " * 30), (92, ""), (93, " \n x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.passage_dedup(docs).collect()}
    assert {i: t.split() for i, t in got.items()} == want and got[0] == rows[0][1] and got[93] == " \n x"
    assert [len(want[i]) for i in (1, 41, 51, 90, 91)] == [40, 40, 90, 51, 0]
    left = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.remove_lines(spark, docs, "").collect()}
    assert len(left[1]) == 40 and all(set(left[i + 1]).isdisjoint(left[i]) for i in (0, 10, 20, 30, 40))


def test_random_passages_equal_brute_force(spark):
    """Passages cut and joined anywhere, in few and in many words, repeated within a text and over texts; periodic stretches too."""
    rng = random.Random(11)
    stock = [[f"v{rng.randrange(10**4)}" for _ in range(rng.randint(52, 160))] for _ in range(6)] + [["p", "q", "r"] * 40, ["z"] * 90]
    rows = []
    for k in range(90):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [f"u{rng.randrange(10**5)}" for _ in range(rng.randint(0, 30))]
            some = rng.choice(stock)
            a = rng.randint(0, len(some) // 3)
            words += some[a : rng.randint(a + 40, len(some))]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"].split() for r in line_dedup.passage_dedup(docs).collect()} == brute(rows)


def test_digests_that_meet_are_drawn_anew(spark, monkeypatch):
    real, tries = line_dedup._windows, []

    def meet(bodies, seed):
        from pyspark.sql import functions as F

        tries.append(seed)
        later = real(bodies, seed)
        if seed == 0:  # as if windows that differ had one digest
            wrong = bodies.orderBy(line_dedup.BODY).limit(1).select(F.col(line_dedup.DIGEST).alias("x")).first()["x"]
            other = bodies.where(F.col(line_dedup.DIGEST) != wrong).limit(1).select(line_dedup.DIGEST, F.lit(0).alias("o"), *[F.col(f"{line_dedup.FIRST}.{c}").alias(c) for c in ("unknown", "doc", "mark", "pos")], F.lit(wrong).alias("other"), F.lit(0).alias("at"))
            later = later.unionByName(other)
        return later

    monkeypatch.setattr(line_dedup, "_windows", meet)
    rng = random.Random(5)
    passage = [f"v{rng.randrange(10**6)}" for _ in range(70)]
    rows = [(k, " ".join([f"a{k}", *passage[k:], f"b{k}"])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"].split() for r in line_dedup.passage_dedup(docs).collect()} == brute(rows) and tries == [0, 1]


def test_lines_end_where_the_pattern_of_their_ends_says(spark):
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab .!?\n\r") for _ in range(rng.randrange(40))) for _ in range(800)] + ["", "\n", "...", "a. ", "? ?"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lines"] for r in rows.select("doc_id", line_dedup.lines_of(rows["text"]).alias("lines")).collect()}
    assert [got[k] for k in range(len(texts))] == [[x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t) if x] or [""] for t in texts]


def test_results_of_stages_and_runs_are_read_in_any_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    a, b = corpus_pipeline.keep_one(spark, docs, ""), corpus_pipeline.mix(spark, docs, "")
    c = corpus_pipeline.keep_one(spark, docs, "")
    assert a.count() == c.count() > 0 and b.count() > 0 and a.count() == a.select("doc_id").count()
    one, two = (corpus_pipeline.run(spark, "/root/testdata/sf0.001") for _ in range(2))
    assert two.count() == one.count() > 0
