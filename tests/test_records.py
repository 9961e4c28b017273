import re

from pyspark.sql import functions as F

from tracewright.sources import records


def test_a_record_is_walked_through_a_few_times(spark):
    """What a record says is taken from a few structs, each found in one pass; a look-up by path goes through the record and copies what it finds."""
    lines = spark.createDataFrame([('{"type": "user"}',)], "line string").repartition(2)
    plan = records.with_told(lines.select(records.value_of(F.col("line")).alias("v"))).select("told")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("variant_get", plan)) < 100


def test_odd_numbers_and_lone_surrogates_stay_with_python(spark):
    said = [f'{{"n": {"1" * 37}}}', f'{{"n": {"1" * 38}}}', '{"n": 1e99}', '{"n": 1e+999}', '{"n": 1E999}', r'{"s": "😀"}', r'{"s": "\ud83d"}', r'{"s": "\uDE00"}', r'{"s": "\ud83dx\ude00"}', r'{"s": "é"}']
    rows = spark.createDataFrame(list(enumerate(said)), "k int, line string").select("k", records.value_of(F.col("line")).isNotNull().alias("plain")).orderBy("k").collect()
    assert [r["plain"] for r in rows] == [True, False, True, False, False, True, False, False, False, True]
