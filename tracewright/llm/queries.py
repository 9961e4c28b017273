"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup, hard_negatives, licenses, line_dedup, media, mixing, near_dedup, packing, sharding, spelling, substrings, token_counts, toxicity
from tracewright.llm.common import documents, shared_folder, stored
from tracewright.sources.scratch import drop, under


def tokenizer() -> str:
    """The vocabulary's file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir)).drop("set_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lies in the shared folder and stays: a later call encodes only texts that no call before has met."""
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer(), cache=f"{shared_folder(spark)}/tracewright-cache/token-counts")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licences(documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licences")], "licence", "commercial")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the pipeline's stage: line dedup, then passages wherever lines end."""
    with under(spark, "chunks") as folder:
        lines = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), counted=False)
    lines = stored(lines, "lines")
    drop(spark, folder)
    return line_dedup.passage_dedup(lines).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id", "source"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP5_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::BIGINT AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER ()::BIGINT - 3 * coalesce(sum(source_size) OVER o, 0)::BIGINT AS remaining,
         sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT AS share, row_number() OVER (ORDER BY source_size / weight, rank) AS pos
  FROM w WINDOW o AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT * FROM f WHERE weight * remaining < 3 * source_size * share ORDER BY pos LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.pos IS NULL OR f.pos < l.pos THEN (3 * f.source_size)::DOUBLE ELSE (f.weight * l.remaining)::DOUBLE / l.share::DOUBLE END AS target
  FROM f LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (take // source_size) * size + greatest(0, least(size, take % source_size - start)) END::BIGINT AS taken
FROM p
"""

def op8_sql() -> str:
    """The tables of sentences and rules as they stand in licenses.py; what is made of them is said here anew: splitting, sentences over several lines, identifiers of parts, sequences, order."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {text(i)}, {text(s)})" for k, (i, s) in enumerate([*licenses.IN_SHORT.items(), *licenses.SENTENCES.items()]))
    rules = ", ".join(f"({k}, {text(name)}, {text(licence)}, {commercial}, {list(seq)})" for k, (name, licence, commercial, seq) in enumerate(licenses.RULES))
    cut = lambda x: rf"string_split(regexp_replace(regexp_replace({x}, '[.!?;]+([\x20\x09-\x0D])', chr(10) || '\1', 'g'), '[.!?;]+$', ''), chr(10))"
    return rf"""
WITH RECURSIVE raw(place, id, sentence) AS (VALUES {values}),
cut AS (SELECT place, id, list_filter(list_transform({cut("sentence")}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM raw),
known AS (SELECT arg_max(id || CASE WHEN k > 1 THEN '.' || k ELSE '' END, place) AS id, part AS sentence FROM (SELECT place, id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut) GROUP BY part),
asked(k, name, licence, commercial, ids) AS (VALUES {rules}),
rule AS (
  SELECT a.k, name, licence, commercial, list(known.id ORDER BY a.at, p.i) AS seq
  FROM (SELECT k, name, licence, commercial, unnest(ids) AS id, generate_subscripts(ids, 1) AS at FROM asked) a
  JOIN (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut QUALIFY place = max(place) OVER (PARTITION BY id)) p ON p.id = a.id
  JOIN known ON known.sentence = p.part GROUP BY ALL),
wider AS (
  SELECT a.k AS small, b.k AS big FROM rule a JOIN rule b ON len(a.seq) < len(b.seq)
  AND regexp_matches(',' || array_to_string(b.seq, ',') || ',', ',' || array_to_string(a.seq, ',(.*,)?') || ',')),
c AS (
  SELECT doc_id, len(list_filter({cut("coalesce(text, '')")}, lambda x: regexp_matches(x, '[A-Za-z0-9]'))) AS n_sentences,
         regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;]+([\x20\x09-\x0D])', chr(10) || chr(10) || '\1', 'g'), '[.!?;]+$', chr(10) || chr(10)) AS ended FROM documents),
w AS (SELECT doc_id, n_sentences, trim(regexp_replace(regexp_replace(regexp_replace(ended, '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n+', 'X', 'g')) AS bare FROM c),
p AS (SELECT doc_id, unnest(string_split(bare, 'X')) AS part, generate_subscripts(string_split(bare, 'X'), 1) AS s FROM w),
q AS (SELECT doc_id, s, list_filter(string_split(part, chr(10)), lambda x: x <> '') AS lines FROM p),
a AS (SELECT doc_id, s, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM q),
-- a known sentence may run over several lines of a part, but begins and ends with one
e AS (SELECT a.*, k.id, k.sentence FROM a JOIN known k ON starts_with(k.sentence, a.line)),
g AS (SELECT doc_id, s, i, id, list_position(list_transform(range(i, len(lines) + 1), lambda j: array_to_string(lines[i:j], ' ')), sentence) AS n FROM e),
m AS (SELECT doc_id, s, i, max(i + n - 1) AS j, arg_max(id, n) AS id FROM g WHERE n > 0 GROUP BY doc_id, s, i),
x AS (SELECT v.doc_id, v.s, v.i, v.id, min(u.i) AS next FROM m v LEFT JOIN m u ON u.doc_id = v.doc_id AND u.s = v.s AND u.i > v.j GROUP BY ALL),
t AS (
  SELECT * FROM x WHERE i = (SELECT min(y.i) FROM x y WHERE y.doc_id = x.doc_id AND y.s = x.s)
  UNION ALL SELECT x.* FROM t JOIN x ON x.doc_id = t.doc_id AND x.s = t.s AND x.i = t.next),
d AS (SELECT w.doc_id, any_value(n_sentences) AS n_sentences, coalesce(string_agg(id, ',' ORDER BY s, i), '') AS sentence_ids FROM w LEFT JOIN t ON t.doc_id = w.doc_id GROUP BY w.doc_id),
h AS (SELECT d.doc_id, r.* FROM d JOIN rule r ON regexp_matches(',' || d.sentence_ids || ',', ',' || array_to_string(r.seq, ',(.*,)?') || ',') WHERE d.sentence_ids <> ''),
f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g JOIN wider w ON w.big = g.k WHERE g.doc_id = h.doc_id AND w.small = h.k)),
l AS (SELECT doc_id, licence, min(k) AS k FROM f GROUP BY doc_id, licence),
o AS (
  SELECT f.doc_id, string_agg(name, ',' ORDER BY k) AS rules, arg_min(licence, k) AS licence, bool_and(commercial) AS commercial,
         (SELECT string_agg(l.licence, ',' ORDER BY l.k) FROM l WHERE l.doc_id = f.doc_id) AS licences
  FROM f GROUP BY f.doc_id)
SELECT x.doc_id, coalesce(d.n_sentences, 0)::BIGINT AS n_sentences, coalesce(d.sentence_ids, '') AS sentence_ids, coalesce(o.rules, '') AS rules,
       coalesce(o.licences, '') AS licences, o.licence, o.commercial
FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id LEFT JOIN o ON o.doc_id = x.doc_id
"""


BLANK = r"[\x20\x09-\x0D]"
CHUNKS_SQL = rf"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS lines FROM documents),
l AS (SELECT * FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t) WHERE line <> '' OR i = 1),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
h AS (SELECT *, ('0x' || substr(md5(bare), 1, 8))::BIGINT AS h FROM b),
c AS (
  SELECT *, coalesce(((lag(h) OVER w * {line_dedup.FACTOR} + h) % {line_dedup.HASH_SPACE} >> 7) % {line_dedup.DIVISOR} = 0, false) OR lead(i) OVER w IS NULL AS ends
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c),
k AS (SELECT doc_id, pos, string_agg(bare, chr(10) ORDER BY i) AS body, string_agg(line, '' ORDER BY i) AS lines, count(*) AS n_lines FROM n GROUP BY doc_id, pos),
g AS (SELECT *, n_lines > 1 AND row_number() OVER (PARTITION BY n_lines > 1, body ORDER BY doc_id, pos) > 1 AS gone FROM k)"""

OP9_SQL = rf"""{CHUNKS_SQL}
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS removed_chunks, sum(CASE WHEN gone THEN n_lines ELSE 0 END)::BIGINT AS removed_lines,
       sha256(coalesce(string_agg(lines, '' ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM g GROUP BY doc_id
"""

OP9_PASSAGE_SQL = rf"""{CHUNKS_SQL},
x AS (SELECT doc_id, coalesce(string_agg(lines, '' ORDER BY pos) FILTER (NOT gone), '') AS text FROM g GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM x),
d AS (SELECT doc_id, list_transform(range(1, len(words) - 49), lambda s: md5(array_to_string(words[s:s + 50], ' '))) AS digests FROM w WHERE len(words) > 50),
p AS (SELECT doc_id, unnest(digests) AS digest, generate_subscripts(digests, 1) AS s FROM d),
f AS (SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(s) OVER o AS first_s FROM p WINDOW o AS (PARTITION BY digest ORDER BY doc_id, s)),
z AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN first_doc = doc_id THEN greatest(s, first_s + 51) ELSE s END, s + 51)) AS k
  FROM f WHERE first_doc <> doc_id OR first_s <> s),
e AS (SELECT doc_id, regexp_extract_all(text, '(?:^{BLANK}*)?[^\x20\x09-\x0D]+{BLANK}*') AS pieces FROM x SEMI JOIN z USING (doc_id)),
u AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM e),
r AS (SELECT u.doc_id, coalesce(string_agg(piece, '' ORDER BY u.k) FILTER (z.k IS NULL), '') AS text FROM u LEFT JOIN z ON z.doc_id = u.doc_id AND z.k = u.k GROUP BY 1)
SELECT x.doc_id, sha256(coalesce(r.text, x.text)) AS text_sha256 FROM x LEFT JOIN r ON r.doc_id = x.doc_id
"""

#: The table is filled here anew, a turn of a shard at a time: the first slot of its order that is still free.
OP10_SQL = f"""
WITH RECURSIVE names AS (SELECT {len(sharding.SHARDS)} AS n, {sharding.SLOTS} AS m, {list(sharding.SHARDS)} AS shard),
orders AS (
  SELECT n, m, list_transform(shard, lambda x: ('0x' || substr(md5('offset:' || x), 1, 12))::BIGINT % m) AS begin, list_transform(shard, lambda x: ('0x' || substr(md5('stride:' || x), 1, 12))::BIGINT % (m - 1) + 1) AS step FROM names),
turns AS (
  SELECT 0 AS i, list_transform(range(m), lambda x: (-1)::TINYINT) AS owners, n, m, begin, step FROM orders
  UNION ALL
  SELECT i + 1, list_transform(owners, lambda o, p: CASE WHEN p = free THEN (i % n)::TINYINT ELSE o END), n, m, begin, step
  FROM (SELECT *, list_filter(list_transform(range(m), lambda j: (begin[i % n + 1] + j * step[i % n + 1]) % m + 1), lambda p: owners[p] = -1)[1] AS free FROM turns WHERE i < m)),
t AS (SELECT owners FROM turns WHERE i = m),
s AS (SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, source, slot, owners[slot + 1]::INTEGER AS shard FROM s, t
"""

OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS s, words FROM w WHERE len(words) >= 50),
q AS (SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS body FROM p),
l AS (SELECT doc_id, s FROM q QUALIFY min(doc_id) OVER (PARTITION BY body) < doc_id),
z AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM l),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
r AS (
  SELECT u.doc_id, count(z.k)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY u.k) FILTER (z.k IS NULL), '') AS kept
  FROM u LEFT JOIN z ON z.doc_id = u.doc_id AND z.k = u.k GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""

#: SQL without a crc32 works it out, a byte and a bit at a time.
OP13_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*)::BIGINT AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run),
b AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS bytes FROM r),
c AS (
  SELECT doc_id, run, k, xor(list_reduce(
    list_transform(range(0, len(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT),
    lambda a, x: list_reduce(range(8), lambda h, bit: xor(h >> 1, CASE WHEN h & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)), 4294967295), 4294967295) AS h FROM b),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM c GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2),
g AS (SELECT word, n, unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || '_' || substr(word, i + 1)))) AS key FROM v),
d AS (SELECT word, n, unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)))) AS key FROM v),
p AS (
  SELECT x.word, y.word AS other, y.n FROM g x JOIN g y ON x.key = y.key AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.key
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.key),
m AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, {'n': -n, 'word': encode(other)}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN best END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN m USING (word)),
t AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM t WHERE t.word = f.word) AS root, n, n_near, form_n FROM f
"""

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_media_columns": op4_media_columns,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op9_passage_dedup": op9_passage_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op1_near_dedup": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_license_scan": op8_sql(),
    "op9_line_dedup": OP9_SQL,
    "op9_passage_dedup": OP9_PASSAGE_SQL,
    "op10_sharding": OP10_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
