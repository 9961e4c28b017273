"""All labelled rows that are not held out are learnt from and counted, not those alone that training begins with."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import toxicity


def test_rows_beyond_the_first_ones_change_the_network(spark):
    late = F.xxhash64("doc_id") > 0  # training begins with the smallest hashes
    rows = spark.range(600).withColumnRenamed("id", "doc_id")
    labels = rows.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    said = lambda word: rows.select("doc_id", F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, "vile").otherwise("kind"), F.when(late, word), F.lit("and so on")).alias("text"), F.lit("en").alias("lang"))
    one, thresholds = toxicity.fit(said("stone"), labels, 40)
    two, _ = toxicity.fit(said("river"), labels, 40)
    same, again = toxicity.fit(said("stone"), labels, 40)
    assert not np.array_equal(one.words, two.words)
    assert np.array_equal(one.words, same.words) and thresholds == again
