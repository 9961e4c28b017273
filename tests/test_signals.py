"""All phrases in one pass against one search for each."""

import random
import re

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import episodes as E
from tracewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def bounded(phrase, text):
    spaces = "[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", X.SPACES) + "]+"
    return re.search(rf"(?<![a-z0-9]){re.escape(phrase).replace(chr(92) + ' ', spaces)}(?![a-z0-9])", text) is not None


def test_hits_equal_a_search_for_each_phrase(spark):
    pick = random.Random(2)
    words = sorted({w for p in E.CODES.all + E.TELLING.all for w in p.split(" ")})
    glue = [" ", " ", " ", "  ", "\n", "\u00a0", "-", "", ".", "'", "é", "x", "7"]
    texts = ["", "none"] + [p for p in E.TELLING.all] + ["".join(pick.choice(words if pick.random() < 0.8 else ["the", "a"]) + pick.choice(glue) for _ in range(pick.randint(1, 25))) for _ in range(400)]
    for phrases in (E.CODES, E.TELLING):
        asked = phrases.all
        df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("hits", phrases.hits(F.col("t")))
        got = df.select("t", F.array(*[phrases.any_of(F.col("hits"), [p]) for p in asked]).alias("any"), phrases.score(F.col("hits"), asked[::3]).alias("score")).collect()
        for r in got:
            assert r.any == [bounded(p, r.t) for p in asked], r.t
            assert r.score == sum(bounded(p, r.t) for p in asked[::3])


def test_first_rules(spark):
    rules = [("b", ("two words", "gamma")), ("a", ("two",))]
    phrases = X.Phrases(*[p for _, p in rules])
    df = spark.createDataFrame([("two  words",), ("two wordsx",), ("xtwo",), ("gammas gamma two",)], "t string").withColumn("h", phrases.hits(F.col("t")))
    assert [r[0] for r in df.select(phrases.first_rule(F.col("h"), rules)).collect()] == ["b", "a", "unknown", "b"]


def searches(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"regexp_extract_all\(", plan)), len(re.findall("RLIKE", plan))


def test_each_text_is_searched_once(spark):
    assert searches(QUERIES["signal_scores"](spark, SF)) == (1, 0)
    # messages, sentences, and for codes the whole and its difficulty sentence
    assert searches(QUERIES["episode_codes"](spark, SF)) == (4, 0)
