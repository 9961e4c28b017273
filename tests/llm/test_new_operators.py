"""Operators 11 to 13 against brute force, on the odd rows that each must take, and by their rarer paths."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import hard_negatives, near_dedup, spelling, substrings

SCHEMA = "doc_id long, text string, n_words string, word string, n long, __tw_key int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 5, 6) for i, t in rows], SCHEMA)


# --- 11


def windows_removed(rows, window):
    """(doc_id, n_words, n_removed, kept text) of each row, by comparing all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, words in split:
        gone = {k for s in range(len(words) - window + 1) if first[tuple(words[s : s + window])] < rank(i) for k in range(s, s + window)}
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def texts_with_passages(seed, n):
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefgh") + pick.choice("xyz") + pick.choice(["", "é", "日"])
    passages = [[word() for _ in range(pick.randint(8, 40))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(pick.randint(0, 5)):
            words += [word() for _ in range(pick.randint(0, 20))]
            if pick.random() < 0.7:
                p = pick.choice(passages)
                a = pick.randint(0, len(p) // 2)
                words += p[a : pick.randint(a, len(p))]
        rows.append((pick.choice([k, k, k, None, k - 1]), pick.choice([" ", "\n", " \t"]).join(words)))
    return rows


ODD = [
    (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n "), (None, "one two three four five six seven"), (None, None),
    (5, "a " * 300), (6, "b " + "a " * 40), (7, "x"), (7, "y z"), (8, "one  two three\nfour five six seven"), (9, " ".join(f"w{k % 97}" for k in range(30_000))), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"),
]


@pytest.mark.parametrize("most", [4096, 1])  # buckets within tasks, and each window a row
@pytest.mark.parametrize("rows", [ODD, texts_with_passages(1, 150)], ids=["odd", "random"])
def test_substrings_equal_brute_force(spark, rows, most):
    out = substrings.substring_dedup(docs_of(spark, rows), window=6, run=3, most=most)
    assert out.columns == ["doc_id", "text", "word", "n", "__tw_key", "n_words", "n_removed", "removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == windows_removed(rows, 6)
    assert all(r.n_removed == sum(s.end - s.start + 1 for s in r.removed) for r in got)


def test_substrings_of_an_empty_table(spark):
    out = substrings.substring_dedup(docs_of(spark, []).limit(0))
    assert out.count() == 0 and "removed" in out.columns


def test_windows_whose_hashes_meet_are_compared(monkeypatch):
    bodies = [b"a b c d e", b"a b c x e", b"q a b c d"]
    at = (np.zeros(3, np.int64), np.arange(3), 3)
    expected = [x.tolist() for x in substrings._later(bodies, *at)]
    monkeypatch.setattr(substrings, "runs_of", lambda flat, size: np.zeros(len(flat) - size + 1, np.uint64))
    assert [x.tolist() for x in substrings._later(bodies, *at)] == expected == [[1, 2], [0, 1], [0, 2]]


def test_strings_whose_digests_meet_get_others(spark, monkeypatch):
    real = substrings.strings

    def meet(held, window, seed, body):
        from pyspark.sql import functions as F

        out = real(held, window, seed, body)
        return out.withColumn(substrings.DIGEST, F.lit(b"same")) if seed == 0 else out

    monkeypatch.setattr(substrings, "strings", meet)
    rows = texts_with_passages(2, 40)
    got = substrings.substring_dedup(docs_of(spark, rows), window=6, run=3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == windows_removed(rows, 6)


def test_super_kmers_hold_each_window_once():
    texts = [t.encode() for _, t in texts_with_passages(3, 30)] + [b"a " * 200]
    text, start, count, least = substrings.super_kmers(texts, 6, 3)
    held = [(t, s + k) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True) for k in range(n)]
    assert held == [(t, s) for t, x in enumerate(texts) for s in range(len(x.split()) - 5)]
    assert count.max() <= 4 and near_dedup.word_hashes()


# --- 12


def brute_negatives(rows):
    live = [(v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for v, e, label in rows if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for v, label, e in {(v, label, tuple(e)) for v, label, e in live if v is not None and v % 100 == 0}:
        near = sorted(((score(e, f), w) for w, own, f in live if own == label and w != v), key=order)[:5]
        far = sorted(((score(e, f), w) for w, own, f in live if own != label), key=order)
        for p, w in near:
            out += [(v, w, k + 1, x, p, s) for k, (s, x) in enumerate([(s, x) for s, x in far if 80 * p <= 100 * s <= 100 * p][:5])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [4096, 40])
def test_hard_negatives_equal_brute_force(spark, bucket, monkeypatch):
    pick = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in pick.normal(size=pick.choice([6, 6, 5, 0])) * pick.choice([0.01, 1, 30])], int(pick.integers(0, 3))) for k in pick.permutation(500)]
    rows += [(100, rows[3][1], 1), rows[0], rows[0], (None, [1.0] * 6, 1), (None, None, 1), (700, None, 2), (800, [1.0, None], 2), (900, [float("nan")], 1), (901, [float("inf")], 1), (902, [1.0], None), (1000, [0.0] * 6, 2)]
    emb = spark.createDataFrame([(v, e, label, 3) for v, e, label in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(emb, bucket=bucket).collect()), key=repr)
    assert got == brute_negatives(rows) and got


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_buckets_out_of_reach_are_not_visited(spark):
    """Of anchors along the longest vectors none goes down to buckets of short ones."""
    rows = [(k, [100.0 if k < 200 else 0.5, float(k % 3)], k % 2) for k in range(1000)]
    emb = spark.createDataFrame([(v, e, label) for v, e, label in rows if v % 100 or v < 200], "vec_id long, embedding array<float>, label int")
    held = hard_negatives.vectors(emb)
    candidates, facts = hard_negatives.bucketed(hard_negatives.stored(held, "v"), 100)
    assert len(facts) > 4 and [f[1] for f in facts] == sorted((f[1] for f in facts), reverse=True)
    from pyspark.sql import functions as F

    asking = held.where(f"{hard_negatives.NUMBER} = 100").withColumns({"lows": F.array(F.lit(25_600 * 25_600).cast("long")), "tops": F.array(F.lit(hard_negatives.HIGHEST))})
    found = hard_negatives.visits(asking, candidates, facts, False, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and {r.found for r in found.collect()} <= set(range(200))
    assert hard_negatives.visits(asking, candidates, facts[4:], False, 5).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100, [2.0**20 + 1, 3.0], 1), (1, [2.0**20, 5.0], 1), (2, [2.0**20, 4.0], 2), (3, [2.0**20, 1.0], 2)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.hard_negatives(emb).collect()
    exact = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b, strict=True))
    assert [(r.negative_id, r.negative_score) for r in got] == [(2, exact(rows[0][1], rows[2][1])), (3, exact(rows[0][1], rows[3][1]))]


# --- 13


def edits(word, vocabulary):
    """The words of `vocabulary` that are one edit away."""
    letters = {c for w in vocabulary for c in w}
    near = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    near |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (near & set(vocabulary)) - {word}


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    held = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, near = {}, {}
    for w in held:
        near[w] = edits(w, held)
        best = min(near[w], key=lambda x: (-held[x], x), default=None)
        form[w] = best if best and held[best] >= 10 * held[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), held[w], len(near[w]), form[w] and held[form[w]]) for w in held), key=repr)


def words_with_slips():
    pick = random.Random(9)
    base = ["mountain", "mountains", "fountain", "running", "Über-straße", "hallooo", "halloo", "allllly", "naïveté", "RÉSUMÉS", "x" * 80, "ab" * 45]
    rows = []
    for k in range(900):
        said = []
        for _ in range(12):
            w = pick.choice(base[: 1 + pick.randint(0, len(base) - 1)])
            if pick.random() < 0.2:
                at = pick.randrange(len(w))
                w = pick.choice([w[:at] + w[at + 1 :], w[:at] + pick.choice("aeiouxß") + w[at + 1 :], w[:at] + pick.choice("aeioux") + w[at:]])
            said.append(w)
        rows.append((k, pick.choice([" ", ", ", "4"]).join(said)))
    return [*rows, rows[3], (None, "mountain running running"), (5000, None), (5001, ""), (5002, "mountain"), (5002, "mountain")]


def test_variants_equal_brute_force(spark):
    rows = words_with_slips()
    got = sorted((tuple(r) for r in spelling.variants(docs_of(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    expected = brute_variants(rows)
    assert got == expected
    assert any(r[1] and r[1] != r[2] for r in expected) or sum(r[1] is not None for r in expected) > 20
    assert any(len(r[0]) > spelling.LONG and r[1] for r in expected) and any(len(r[0]) == spelling.LONG + 1 or len(r[0]) > 70 for r in expected)


def test_variants_of_words_around_the_bound(spark, monkeypatch):
    """Words of 64 and 65 code points meet, though the deletions of the one stand in keys as they are and of the other not."""
    a = "".join(chr(97 + k % 26) for k in range(64))
    rows = [(None, " ".join([a] * 40 + [a + "z"] * 3 + [a[:30] + "zz" + a[30:]] * 2 + [a[:10] + "Z" + a[11:]] * 2))]
    assert sorted((tuple(r) for r in spelling.variants(docs_of(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == brute_variants(rows)


def test_a_very_long_word(spark):
    word = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(20_000))
    rows = [(None, f"{word} {word} " + f"{word}x " * 20)]
    got = {r.word: r.form for r in spelling.variants(docs_of(spark, rows)).collect()}
    assert got == {word: f"{word}x", f"{word}x": None}


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)], f"{spelling.WORD} string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w11"}


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(docs_of(spark, []).limit(0)).count() == 0
