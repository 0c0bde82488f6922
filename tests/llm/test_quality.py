import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import quality as q


def test_measure():
    got = dict(zip(q.STATISTICS, q.measure("Aa aa aa | b!\nAa aa aa | b!\n"), strict=True))
    assert (got["words"], got["words_per_line"], got["line_repeat"]) == (10, 5, 0.5)
    assert math.isclose(got["repeat_share"], 0.2) and math.isclose(got["short_share"], 1.0) and math.isclose(got["pipe_share"], 2 / 28)
    assert set(q.measure("")) == set(q.measure(None)) == {0.0}
    assert q.measure("  \n ")[1] == 0


def test_rules_fit_and_compile(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, len(q.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(int)
    m = q.fit_rules(x, y)
    assert 0 < len(m.rules) < 120 and all(len(r.terms) <= 3 for r in m.rules)
    cols = {k: F.col(k) for k in q.STATISTICS}
    df = spark.createDataFrame(x[:200].tolist(), list(q.STATISTICS))
    got = np.array([r.s for r in df.select(m.score(cols).alias("s")).collect()])
    total = np.full(200, m.bias)  # brute force: rule by rule
    for r in m.rules:
        holds = np.ones(200, bool)
        for name, above, cut in r.terms:
            v = x[:200, q.STATISTICS.index(name)]
            holds &= (v > cut) if above else (v <= cut)
        total += r.weight * holds
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got >= 0.5) == y[:200]).mean() > 0.97


def test_no_or_one_class():
    assert q.fit_rules(np.zeros((0, 14)), np.zeros(0)).bias == 0 and not q.fit_rules(np.ones((5, 14)), np.ones(5)).rules


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = q.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got[got.held_out].predicted == got[got.held_out].quality).mean() > 0.98


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (2, None, 5), (3, 7, 5), (None, 1, 5)], "doc_id long, quality int, text int")
    docs = spark.createDataFrame([(1, "a", "e"), (2, None, "e"), (None, "", "e"), (1, "a", "e")], "doc_id long, text string, quality_stats string")
    for used in (labels, labels.limit(0)):
        m = q.fit(docs, used.select("doc_id", "quality"))
        rows = q.score(docs, m).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert q.score(docs.limit(0).select("doc_id", "text"), m).count() == 0
    assert pytest.approx(0.5) == 1 / (1 + math.exp(-q.fit_rules(np.zeros((0, 14)), np.zeros(0)).bias))
