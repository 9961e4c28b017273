import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame

from tracewright.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_a_network_is_the_same_in_parts():
    net = toxicity.Network.fresh(np.random.default_rng(3))
    net.bias = 0.25
    parts = list(net.parts())
    again = toxicity.Network.joined(reversed(parts))
    assert max(len(raw) for _, raw in parts) < 300_000
    assert (again.words == net.words).all() and all((a == b).all() for a, b in zip(again.filters, net.filters, strict=True)) and (again.bias, again.constant) == (0.25, None)
    assert again.score(["some words", ""]).tolist() == net.score(["some words", ""]).tolist()


def test_the_driver_holds_a_network_once(spark, monkeypatch):
    sent, got = [], []
    broadcast, collect = SparkContext.broadcast, DataFrame.collect
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    net, _ = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert net.constant is None
    assert len(sent) >= 2 and not any(b._jbroadcast.isValid() for b in sent)  # no broadcast that `fit` made is left
    assert not any(isinstance(v, (bytes, bytearray)) for rows in got for r in (rows if isinstance(rows, list) else [rows]) for v in r)
