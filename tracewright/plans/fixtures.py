"""Relations derived from the synthetic tables, whose own prose carries no signals. Spark and SQL are built from the same lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_LENGTH = 240

#: Text by event type: (modulus, one text for each remainder; the last serves all higher ones).
NARRATION = {
    "signup": (2, ("I will inspect the upload path and map how the export is wired.", "Let me open the handler and follow the call.")),
    "view": (8, ("Please fix the failing login error and verify it.",) * 4 + ("The report renders as normal.",)),
    "click": (8, (
        "Instead of dropping the column, I will narrow the change to a small patch.", "I will decompose this and split the work step by step.", "The workaround is to bypass the cache for now.",
        "I will roll back the last edit and revert the flag.", "It turns out the assumption was wrong, so I will try another route.", "The helper is straightforward and local.",
        "I refactor the schema into a new module.", "I looked at the context again.",
    )),
    "purchase": (8, (
        "Done, fixed, and complete; it should work now.", "The fix is implemented and verified with forward checks.", "This is partially done; only a subset is covered.",
        "I could not finish and the test is still failing.", "Caveat: the deployed path needs verification.", "It is resolved, assuming the default config.", "Not sure yet, but I proceed.", "The run passes.",
    )),
    "error": (20, (
        "The auth test still fails with a timeout and there is a risk that the retry hides the bug.", "The requirement is ambiguous, but the spec is unclear.",
        "The migration has a compatibility risk and may break existing behavior.", "I do not know where the issue is; the root cause is a mismatch.",
        "The shared architecture has a conflict and unexpected coupling.", "This edge case is tricky; there is a problem and an error.", "Missing context: I cannot inspect the file.",
        "The result is unexpected; there is a mismatch.", "The sandbox network is blocked and a dependency is missing.", "I cannot verify this locally, so I will add a guard and a fallback.",
        "The plan failed with an error, so I will try another reader and switch to the stream.", "The timeout is not a server problem; verify with a local trace.", "The log output looks normal.",
    )),
}


def _branches() -> list[tuple[str, int, int, bool, str]]:
    """(event type, modulus, remainder, whether higher remainders count too, text)."""
    return [(t, m, k, k == len(texts) - 1, text) for t, (m, texts) in NARRATION.items() for k, text in enumerate(texts)]


def narrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.lit(None).cast("string")
    for kind, m, k, more, said in reversed(_branches()):
        rest = F.col("event_id") % m
        text = F.when((F.col("event_type") == kind) & ((rest >= k) if more else (rest == k)), said).otherwise(text)
    user = (F.col("event_type") == "view") & (F.col("event_id") % 8 < 4)
    return e.select(
        F.expr(f"event_id div {TRACE_LENGTH}").alias("trace_id"), (F.col("event_id") % TRACE_LENGTH).alias("msg_index"), F.when(user, "user").otherwise("assistant").alias("role"),
        text.alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("narrated").alias("source"),
    )


def narrated_sql() -> str:
    whens = " ".join(f"WHEN event_type = '{t}' AND event_id % {m} {'>=' if more else '='} {k} THEN '{said}'" for t, m, k, more, said in _branches())
    return f"""narrated AS (
  SELECT event_id // {TRACE_LENGTH} AS trace_id, event_id % {TRACE_LENGTH} AS msg_index,
         CASE WHEN event_type = 'view' AND event_id % 8 < 4 THEN 'user' ELSE 'assistant' END AS role, CASE {whens} END AS text,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp
  FROM events)"""


#: A secret for each remainder of doc_id by 15, one for each redaction rule; in pieces, so that no scanner takes them for real ones.
SECRETS = (
    "'Authorization: Bearer ' || repeat('a', 16)", "'gh' || 'p_' || repeat('b', 24)", "'github' || '_pat_' || repeat('c', 24)", "'sk' || '-proj-' || repeat('d', 24)", "'h' || 'f_' || repeat('e', 24)",
    "'gl' || 'pat-' || repeat('f', 24)", "'AK' || 'IA' || repeat('A', 16)", "'xo' || 'xb-' || repeat('1', 24)",
    "'-----BEGIN RSA ' || 'PRIVATE KEY-----' || chr(10) || repeat('k', 32) || chr(10) || '-----END RSA ' || 'PRIVATE KEY-----'", "'user7@example.com'", "'/Users/alice/project/x.py'",
    "'/home/alice/project/x.py'", "'D:' || chr(92) || 'Users' || chr(92) || 'alice' || chr(92) || 'p' || chr(92) || 'x.txt'", "'https://example.com/cb?code=1'", "repeat('Q', 52)",
)


def planted_text() -> str:
    """SQL, good for both engines."""
    return "text || ' ' || CASE doc_id % 15 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SECRETS)) + " END || ' end'"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(planted_text()).alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("turn"), F.col("role").alias("raw_role"), "text")


def span_rows(doc_id: Column) -> Column:
    """Detector spans by doc_id % 6: apart, touching, one apart, overlapping of one and of two labels, malformed with an unknown label."""
    span = lambda a, b, label: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(label).alias("label"))
    cases = [
        [span(0, 3, "private_person"), span(6, 9, "private_phone")], [span(0, 3, "private_person"), span(3, 8, "private_person")], [span(0, 3, "private_person"), span(4, 8, "private_person")],
        [span(0, 5, "private_person"), span(3, 8, "private_person")], [span(0, 5, "private_person"), span(3, 8, "private_phone"), span(4, 5, "secret")],
        [span(0, 999999, "private_person"), span(2, 2, "secret"), span(1, 4, "not_a_type"), span(2, 4, "secret")],
    ]
    out = F.array(*cases[-1])
    for k in range(4, -1, -1):
        out = F.when(doc_id % 6 == k, F.array(*cases[k])).otherwise(out)
    return out
