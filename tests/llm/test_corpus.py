"""Corpus operators on small fixtures: brute force, round trips, held-out accuracy, and the odd rows that each must take."""

import random
import re
import shutil
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import exact_dedup, filters, jpeg, licenses, line_dedup, media, mixing, near_dedup, packing, queries, sharding, token_counts, toxicity
from tracewright.llm.common import stored
from tracewright.llm.components import components
from tracewright.llm.word_encoder import Encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot long, n_lines long, kept boolean, __x string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 7, 9, True, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and sources, repeated rows, one id with two texts, a very long text; extra columns with clashing names."""
    return docs_of(spark, [
        (1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"), (2, None, "a"), (3, "", None), (4, " \t\n ", None), (None, "one two three four five six seven", "b"),
        (None, None, None), (5, LONG, "b"), (6, "One two THREE four five six seven", "b"), (7, "x", "c"), (7, "y z", "c"), (8, "one  two three\nfour five six seven", "c"),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = c.execute(queries.ORACLES[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    expected = sorted(tuple(repr(r[theirs.index(x)]) for x in columns) for r in answer.fetchall())
    assert sorted(tuple(repr(r[x]) for x in columns) for r in df.collect()) == expected and expected


# --- components and near-dedup


def reach(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("at_once", [0, 12, 1000])
def test_components(spark, at_once):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40) if k % 9] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(30)] + [(95, 95)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), at_once).collect())
    want = reach(100, edges)
    assert set(found) == {x for e in edges for x in e if e[0] != e[1]}
    for a, b in combinations(found, 2):
        assert (found[a] == found[b]) == (want[a] == want[b])
    assert all(found[found[a]] == found[a] for a in found)
    assert components(spark.createDataFrame([], "a long, b long"), at_once).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    edges = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = reach(len(rows), edges)
    ids = {r: [i for i, _ in (rows[k] for k in range(len(rows)) if root[k] == r) if i is not None] for r in set(root)}
    return sorted(((i, len(sets[k]), min(ids[root[k]], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def varied(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] += f"q{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_dedup_equals_brute_force(spark):
    """A hot group whose copies are linked or not by a hair, chains, exact copies, lone texts."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, varied(rng, base, rng.randrange(0, 9))) for k in range(160)]
    chain = [f"c{k}" for k in range(60)]
    for k in range(160, 175):
        chain = [*chain[2:], f"n{k}", f"m{k}"]
        rows.append((k, " ".join(chain)))
    rows += [(k, rows[k - 175][1]) for k in range(175, 185)] + [(k, " ".join(f"l{k}_{j}" for j in range(rng.randrange(1, 30)))) for k in range(185, 215)]
    found = near_dedup.near_dedup(docs_of(spark, [(i, t, "a") for i, t in rows]))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == brute_near(rows)


def test_blocks_connect_all_that_is_apart(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    texts = sorted({varied(rng, base, rng.randrange(0, 8)) for _ in range(60)})
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    nodes = [near_dedup.set_digest(s) for s in sets]
    apart = spark.createDataFrame([(1, n, len(s), n) for n, s in zip(nodes, sets, strict=True)], "band long, node binary, n long, root binary")
    held = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(nodes, sets, strict=True)], "node binary, shingles binary")
    links = near_dedup.across(apart, held, most=7)
    found = {bytes(r["node"]): bytes(r["root"]) for r in components(links).collect()}
    at = {n: k for k, n in enumerate(nodes)}
    edges = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    want = reach(len(sets), edges)
    got = reach(len(sets), [(at[n], at[r]) for n, r in found.items()])
    assert got == want


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    s = near_dedup.sketches([np.unique(a[:2000]), np.unique(a[500:2000]), np.unique(a[:1]), np.unique(a[:9])])
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.15


def test_near_dedup_takes_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = near_dedup.near_dedup(odd).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert near_dedup.near_dedup(empty).count() == 0


# --- packing and token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_pieces(pieces, texts, library, length):
    """Every id of every row in one piece, sequences gapless and full but for the last."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, own in texts.items():
        streams = [[*library(t), 1] for t in own]
        assert sum(p["length"] for p in by_doc[i]) == sum(map(len, streams))
        for p in by_doc[i]:
            assert p["ids_crc32"] in {zlib.crc32(np.asarray(s[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for s in streams if len(s) == p["doc_tokens"]}
        if len(own) == 1:  # start to end without a gap
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    last = max(by_sequence)
    for k, ps in by_sequence.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length if k < last else 0 < at <= length
    assert sorted(by_sequence) == list(range(last + 1))


def test_packing_round_trip(spark, odd, empty, library):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    pieces = packing.pack(odd, queries.tokenizer(), length=64, with_ids=True)
    check_pieces(pieces.collect(), texts, library, 64)
    whole = packing.sequences(pieces, 64).collect()
    assert all(len(r["ids"]) == 4 * 64 for r in whole)
    assert sum(r["n_tokens"] for r in whole) == sum(len(library(t)) + 1 for ts in texts.values() for t in ts)
    assert packing.pack(empty, queries.tokenizer()).count() == 0


def test_encoder_gives_the_librarys_ids(library):
    rng = random.Random(1)
    bits = ["a", "B", "'s", "'S", "é", "É", "İ", "ß", "ſ", "<|endoftext|>", "<|", "|>", "  ", "\n", "\t", " ", "\x1c", "\x85", "\r\n", "9", "٣", "漢字", "😀", "!", "--", "'", "''ll", "ñ", "́", "ﬁ", "Σ", "ς", "·", "½", "×", " ", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(1500)] + ["x" * 5000, LONG]
    encode = Encoder(queries.tokenizer())
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [library(t) for t in texts]


def test_other_tokenizers(library):
    import public_tokenizers
    import sentencepiece

    byte_level = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" a  b", add_special_tokens=False).ids
    assert not byte_level.by_word and np.frombuffer(byte_level([" a  b"])[0], "<u4").tolist() == ids
    pieces = Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode("Hello there")
    assert np.frombuffer(pieces(["Hello there"])[0], "<u4").tolist() == want


def test_token_counts_and_their_cache(spark, odd, empty, library, tmp_path, monkeypatch):
    cache, encoded = str(tmp_path / "cache"), []
    real = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda misses, tokenizer: encoded.append(misses.select(token_counts.DIGEST).distinct().count()) or real(misses, tokenizer))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library(r["text"])), len(library(r["text"])) > 2048) for r in odd.collect()), key=repr)
    for _ in range(2):
        found = token_counts.token_counts(odd, queries.tokenizer(), cache=cache)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == encoded[0] and encoded[1] == 0
    more = odd.union(docs_of(spark, [(70, "a text that no call has met", "a"), (71, LONG, "a")]))
    assert token_counts.token_counts(more, queries.tokenizer(), cache=cache).count() == odd.count() + 2 and encoded[2] == 1
    assert token_counts.token_counts(empty, queries.tokenizer()).count() == 0


def test_the_query_keeps_its_cache(spark, monkeypatch):
    encoded, real = [], token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda misses, tokenizer: encoded.append(misses.count()) or real(misses, tokenizer))
    rows = [sorted(queries.op6_token_counts(spark, SF).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and encoded[1] == 0


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    words, bad = [f"w{k}" for k in range(300)], ["idiot", "scum", "lowen", "lowik", "lowart"]
    rows, marks = [], []
    for k in range(500):
        toxic = rng.random() < 0.3
        said = [rng.choice(words) for _ in range(rng.randrange(10, 60))]
        for _ in range(2 * toxic):
            said.insert(rng.randrange(len(said)), rng.choice(bad))
        rows.append((k, " ".join(said), "a"))
        marks.append((k, 1, int(toxic)))
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    truth = {i: t for i, _, t in marks}
    aside = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in aside} == {k for k in range(500) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in aside]) > 0.95
    again = toxicity.toxicity(docs, labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()
    assert sorted(found) == sorted(again)  # held-out labels play no part


def test_toxicity_takes_odd_rows(spark, odd, empty, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.threshold(np.array([0.9, 0.9, 0.2]), np.array([1, 1, 0])) == toxicity.DEFAULT


# --- media


def test_pictures_give_back_any_bytes():
    rng = np.random.default_rng(0)
    payloads = [media.padded(rng.integers(0, 256, n, np.uint8).tobytes()) for n in (0, 1, 191, 192, 193, 5000)] + [media.padded(b"j" * 700), media.padded(LONG.encode())]
    together = media.from_jpeg(media.to_jpeg(payloads))
    assert [p for p, _ in together] == payloads
    for p, (_, picture) in zip(payloads, together, strict=True):
        alone = media.to_jpeg([p])
        assert np.array_equal(media.from_jpeg(alone)[0][1], picture)
        assert picture.shape[2] == 3 and picture.shape[0] % 16 == 0


def test_inverse_transform_and_zigzag():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    flat = np.zeros((1, 64))
    flat[0, 0] = 80
    assert np.rint(flat @ jpeg.INVERSE / 2**13).tolist() == [[10.0] * 64]


def test_scans_without_restarts_and_with_runs():
    """One lane for each scan: restart markers taken out, all blocks zero or nearly so, bands ended one block at a time."""
    rng = np.random.default_rng(4)
    blocks = np.where(rng.random((9, 6, 64)) < 0.93, 0, rng.integers(-400, 400, (9, 6, 64)))
    image = jpeg.parse(jpeg.encode([blocks], [b"0"])[0])
    assert np.array_equal(jpeg.decode([image])[0][jpeg.order_of(image, (0, 1, 2))[0]].reshape(-1, 6, 64)[:9], blocks)


def test_media_take_odd_rows(odd, empty):
    rows = media.media_columns(odd, tensors=True).collect()
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= max(192, r["n_bytes"]) and len(r["rgb"]) == r["height"] * r["width"] * 3 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["payload_sha256"], set()).add((r["feature"], r["media_sha256"], r["tail_crc32"]))
    assert all(len(v) == 1 for v in by_id.values())
    assert media.media_columns(empty).count() == 0


# --- exact dedup, sharding, licences


def test_exact_dedup_takes_odd_rows_and_collisions(odd, empty):
    want = {}
    for r in odd.collect():
        body = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        want.setdefault(body, []).append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    expected = [((i if not u else None), (min(g)[2] if not min(g)[1] else None), len(g), (n, u, i) == min(g)) for g in want.values() for n, u, i in g]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for digest in (exact_dedup.sha256, lambda t: F.unhex(F.hex(F.length(t) % 3))):
        found = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd, digest).collect()]
        assert sorted(found, key=key) == sorted(expected, key=key)
    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd, batches=9, part=1).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_digest_index_levels_and_filters(spark, tmp_path):
    rows = spark.range(2000).select(F.unhex(F.md5((F.col("id") % 700).cast("string"))).alias(exact_dedup.DIGEST), F.struct(F.col("id").alias("doc_id")).alias(exact_dedup.FIRST))
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    for k in range(6):
        index.flush(rows.where(F.col(f"{exact_dedup.FIRST}.doc_id") % 6 == k))
    assert [len(runs) for runs in index.levels] == [2, 1]
    level = index.merged()
    got = {bytes(r[0]): (r[1]["doc_id"], r[2]) for r in level.collect()}
    want = {}
    for r in rows.collect():
        first, n = want.get(bytes(r[0]), (r[1]["doc_id"], 0))
        want[bytes(r[0])] = (min(first, r[1]["doc_id"]), n + 1)
    assert got == want
    some = level.where(f"{exact_dedup.FIRST}.doc_id < 90")
    few = filters.Filter(some, exact_dedup.DIGEST)
    held = few.may_hold(level, exact_dedup.DIGEST)
    assert held.join(some, exact_dedup.DIGEST, "left_semi").count() == 90 and held.count() < 150 and few.bits == 1 << 15
    assert filters.Filter(some.limit(0), exact_dedup.DIGEST).may_hold(level, exact_dedup.DIGEST).count() == 0


def test_a_run_whose_filter_says_no_is_not_read(spark, tmp_path):
    rows = spark.range(600).select(F.unhex(F.md5(F.col("id").cast("string"))).alias(exact_dedup.DIGEST), F.struct(F.col("id").alias("doc_id")).alias(exact_dedup.FIRST))
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    parts = [rows.where(F.col(f"{exact_dedup.FIRST}.doc_id").between(200 * k, 200 * k + 199)) for k in range(3)]
    for part in parts:
        index.flush(part)
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "index" / "level0").iterdir()) == ["filter"] * 3 + ["run"] * 3
    asked = parts[1].where(f"{exact_dedup.FIRST}.doc_id < 210").union(rows.select(F.unhex(F.md5(F.lit("never"))), exact_dedup.FIRST).limit(3))
    shutil.rmtree(index.runs()[0].rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])  # it would fail if it were read
    assert sorted(r[exact_dedup.FIRST]["doc_id"] for r in index.lookup(asked).collect()) == list(range(200, 210))
    assert index.lookup(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        index.lookup(parts[0].limit(5)).collect()


def test_sharding(odd, empty):
    owners = sharding.lookup_table()
    counts = np.bincount(owners)
    assert len(owners) == sharding.SLOTS and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = np.mean([a != b for a, b in zip(owners, fewer, strict=True) if a != len(sharding.SHARDS) - 1])
    assert moved < 0.15
    with pytest.raises(ValueError):
        sharding.lookup_table(slots=4096)
    rows = sharding.place(odd).collect()
    assert len(rows) == odd.count() and all(r["shard"] == owners[r["slot"]] for r in rows)
    assert len({r["slot"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.place(empty).count() == 0


def test_sharded_files(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()
    hot = spark.range(6000).select(F.lit(5).alias("doc_id"), F.col("id").alias("x"))  # one key
    sharding.write_shards(hot, str(tmp_path / "hot"), rows_a_file=100)
    written = spark.read.parquet(str(tmp_path / "hot")).groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(written) > 30 and max(r["count"] for r in written) <= 200 and sum(r["count"] for r in written) == 6000


def test_licence_rules(spark, odd, empty):
    s = licenses.SENTENCES
    texts = [
        "Intro.\nReleased under the MIT License.", f"{s['apache-notice-2']}; {s['apache-use']}.\n{s['apache-obtain']}\n", f"{s['apache-use']}. {s['apache-notice-2']}.", f"{s['mit-grant']}. x {s['mit-condition']}.",
        f"{s['mit-grant']}.\nThen more.\n{s['mit-condition']}.\n{s['as-is']}!", "LICENSED  under CC BY-NC 4.0\nReleased under the MIT License", s["mpl-notice"] + ".", "nothing here",
    ]
    found = licenses.licences(docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["rules"] for r in found] == [["mit-notice"], ["apache-header"], ["apache-notice-2"], ["mit-grant-only"], ["mit-text"], ["mit-notice", "cc-by-nc-notice"], ["mpl-notice"], []]
    assert found[5]["commercial"] is False and found[7]["commercial"] is None and found[5]["licence"] == "MIT"
    assert licenses.licences(odd).where("licence IS NOT NULL").count() == 0 and licenses.licences(empty).count() == 0


# --- line dedup and mixing


def test_line_dedup_finds_shifted_passages_in_lines_and_paragraphs(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(8))
    passage, said = [line() for _ in range(30)], [line() + "." for _ in range(20)]
    rows = [(k, "\n".join([line() for _ in range(rng.randrange(1, 9))] + passage + [line(), line() + ". " + " ".join(said) + " " + line(), line()]), "a") for k in range(6)]
    rows += [(9, "\n".join(line() for _ in range(20)), "a"), (10, "same\n\n\n\n", "a"), (11, "same\n\n\n\n", "a")]
    docs = docs_of(spark, rows)
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[0]["text"] == rows[0][1] and out[9]["text"] == rows[6][1] and out[0]["removed_lines"] == 0
    for k in range(1, 6):
        left = re.split(r"\n|(?<=\.) ", out[k]["text"])
        assert len(set(left) & set(passage)) <= 12 and len(set(left) & set(said)) <= 12
        assert set(left) >= set(re.split(r"\n|(?<=\.) ", rows[k][1])) - set(passage) - set(said)
        assert out[k]["n_chars"] == len(out[k]["text"])
    whole = line_dedup.chunked(docs).select("text", F.array_join(line_dedup.LINES, "").alias("again"), F.aggregate(line_dedup.CHUNKS, F.lit(0), lambda n, c: n + c["lines"]).alias("n"), F.size(line_dedup.LINES).alias("m"))
    assert whole.where("text <> again OR n <> m").count() == 0


def test_one_long_line_counts_as_one(spark):
    """No length turns a line into several: a repeated line of 50, 51 or 5000 words without a sentence's end stays where no chunk holds it with another."""
    rows = [(10 * k + j, " ".join(f"p{k}x{i}" for i in range(n)), "a") for k, n in enumerate((50, 51, 5000)) for j in range(2)]
    docs = docs_of(spark, rows)
    assert {r["removed_chunks"] for r in line_dedup.line_dedup(docs).collect()} == {0}
    assert [len(r["text"].split()) for r in line_dedup.passage_dedup(docs).orderBy("doc_id").collect()] == [50, 50, 51, 0, 5000, 0]


def test_chunks_of_few_words_go_too(spark):
    """Several lines are a chunk however few words they have; one line never is."""
    docs = docs_of(spark, [(k, "w x.\ny z", "a") for k in range(3)] + [(k, "alone", "a") for k in (5, 6)])
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()} == {0: "w x.\ny z", 1: "", 2: "", 5: "alone", 6: "alone"}
    assert {r["removed_chunks"] > 0 for r in line_dedup.line_dedup(docs, window=1, divisor=1).collect()} == {False}  # one line a chunk


def test_unlike_chunks_of_one_digest_stay(spark, monkeypatch):
    """Bytes decide: with a digest that says nothing, only what equals its first is removed."""
    docs = docs_of(spark, [(k, f"one{k % 3} two and so on.\nthree four{k % 3} and so on.", "a") for k in range(9)])
    monkeypatch.setattr(line_dedup.F, "md5", lambda c: F.lit("00"))
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert {k for k, t in out.items() if not t} == {3, 6} and out[1] == "one1 two and so on.\nthree four1 and so on."


def test_line_dedup_takes_odd_rows(odd, empty):
    out = line_dedup.line_dedup(odd).collect()
    assert len(out) == odd.count() and all(r["text"] is not None for r in out)
    assert {r["n_lines"] for r in out if r["doc_id"] == 8} == {2}
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.passage_dedup(odd).count() == odd.count() and line_dedup.passage_dedup(empty).count() == 0


def test_mixing_targets_and_draws(spark, odd, empty):
    rng = random.Random(8)
    sizes = {"a": 30, "b": 200, "c": 9, "d": 90, None: 4}
    rows = [(len(s or "") + 10 * k + ord((s or "z")[0]) * 1000, " ".join(["w"] * rng.randrange(0, 40)), s) for s, n in sizes.items() for k in range(n)]
    docs = docs_of(spark, rows)
    plan = mixing.mix_plan(docs, rows_a_cell=16).collect()
    total = sum(r["size"] for r in plan)
    by = {s: [r for r in plan if r["source"] == s] for s in sizes}
    weights = dict(zip(("a", "b", "c", "d", None), (5, 2, 1, 5, 2), strict=True))
    caps = {s: 3 * by[s][0]["source_size"] for s in sizes}
    want, open_ = {}, set(sizes)
    while open_:  # share again what stands above a cap
        left = total - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= caps[s]}
        want |= {s: caps[s] for s in above} if above else share
        open_ = open_ - above if above else set()
    for s in sizes:
        assert by[s][0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in by[s])
    assert sorted(plan) == sorted(mixing.mix_plan(docs.repartition(5), rows_a_cell=1000).collect())
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in plan)


def test_targets_of_many_sources(spark):
    """Repeated sharing, against a loop over one list; more sources than a tree holds."""
    rng = random.Random(12)
    sizes = [(f"h{k:04d}", rng.choice((0, 1, 5, 40, 3000))) for k in range(900)] + [(None, 7)]
    got = {r[mixing.SOURCE]: (r["rank"], r["weight"], r["target"]) for r in mixing.targets(spark.createDataFrame(sizes, f"{mixing.SOURCE} string, {mixing.SIZE} long").repartition(5), cap=3).collect()}
    total, weight = sum(n for _, n in sizes), {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(sizes)}
    full: set = set()
    while True:
        left, share = total - 3 * sum(n for s, n in sizes if s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s, n in sizes if s not in full and weight[s] * left >= 3 * n * share}
        if not more:
            break
        full |= more
    for k, (s, n) in enumerate(sizes):
        assert got[s][:2] == (k + 1, weight[s]) and got[s][2] == pytest.approx(3 * n if s in full else weight[s] * left / share)
    assert sum(t for _, _, t in got.values()) == pytest.approx(total)
    docs = docs_of(spark, [(k, "w " * (k % 7), s) for k, (s, _) in enumerate(sizes)])
    plan = mixing.mix_plan(docs).collect()
    by = {}
    for r in plan:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert mixing.mixture(docs).select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in plan)


def test_splitting_tree_is_exact(spark):
    plan = spark.createDataFrame([(1, 10, 25), (2, 3, 3), (3, 5, 0), (4, 40, 70)], "rank long, n_blocks long, quota long")
    rows = mixing.draws_by_shard(plan, 8, "s").collect()
    assert len(rows) == len({(r["rank"], r["epoch"], r[mixing.BLOCK]) for r in rows}) == 98
    shards = np.bincount([r["shard"] for r in rows])
    assert len(shards) == 8 and shards.max() - shards.min() <= 1


def test_mixing_takes_odd_rows(odd, empty):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixture(empty).count() == 0


# --- the pipeline


def test_stages_on_odd_rows(spark, odd, labels, tmp_path, library):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
            docs = out
            assert {(r["n_lines"], r["score"], r["slot"], r["kept"], r["__x"]) for r in docs.collect()} <= {(9, 0.5, 7, True, "x")}  # of others' columns none is touched
    assert out.count() > 0
    names = docs_of(spark, [(1, "a. b. c. d.", "a"), (2, "a. b. c. d.", "a")]).withColumns({"removed_lines": F.lit(True), "removed_chunks": F.lit("x")})
    assert {(r["removed_lines"], r["removed_chunks"]) for r in corpus_pipeline.remove_lines(spark, names, "").collect()} == {(True, "x")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_tables_of_a_stage_go_when_the_next_one_begins(spark, odd):
    from pathlib import Path

    first = stored(corpus_pipeline.remove_lines(spark, odd, ""), "result")
    folder = Path(corpus_pipeline._LEFT[spark.sparkContext.applicationId].removeprefix("file:"))
    assert any(folder.iterdir())
    second = stored(corpus_pipeline.keep_one(spark, first, ""), "result")
    assert not folder.exists() and second.count() > 0 and first.count() == odd.count()


def test_each_stage_against_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["rejected"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = stored(corpus_pipeline.reject_toxic(spark, docs, SF), "kept")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, bad in scores.items() if not bad}
    lines = stored(corpus_pipeline.remove_lines(spark, kept, SF), "lines")
    assert lines.count() == kept.count()
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    one = stored(corpus_pipeline.keep_one(spark, lines, SF), "one")
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, _, c in brute_near(rows) if i == c)
    mixed = stored(corpus_pipeline.mix(spark, one, SF), "mixed")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(one).collect()}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert got == {i: n for i, n in taken.items() if n}
    pieces = corpus_pipeline.pack(spark, mixed, SF).collect()
    assert sum(p["length"] for p in pieces) == sum(len(library(r["text"])) + 1 for r in mixed.collect())
