import random
from collections import defaultdict

from pyspark.sql import functions as F

from fieldloom.llm import common, mixing


def targets_by_hand(sizes):
    """Water filling by rounds: cap what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = rng.choice(["a"] * 8 + ["b", "c", "d", None])
        n = 0 if i % 50 == 0 else rng.choice([1, 5, 40, 300])
        rows.append((i, None if i % 97 == 0 else " ".join(["word"] * n), source, 1))
    rows += [(5, "twice here", "b", 1), (None, "no id", "c", 1), (None, None, "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_hand(sizes)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for s, rs in by.items():
        assert rs[0].source_size == sizes[s] and abs(rs[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in rs) - want[s]) <= 0.5 + 1e-6
        epochs = int(rs[0].target + 0.5) // max(1, sizes[s])
        assert all(epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size for r in rs)
        assert sum(0 < r.taken - epochs * r.size < r.size for r in rs) <= 1  # one row in part
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_copies(spark):
    df = spark.createDataFrame([(i, "one two three", "abc"[i % 3], "de") for i in range(300)], "doc_id long, text string, source string, lang string")
    out = mixing.mixed_documents(spark, df, "")
    assert out.columns == df.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert (n["a"], n["b"], n["c"]) == (50, 100, 150)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_stage_takes_rows_apart(spark):
    """400 rows of one id, 400 without: each row by itself, as mix() plans."""
    rows = [(i if i < 400 else None if i < 800 else 7, " ".join(["w"] * (1 + i % 40)), "ab"[i % 2], i) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, number long").selectExpr("*", "1 AS n", "'x' AS row", "2 AS times")
    out = mixing.mixed_documents(spark, df, "")
    assert out.columns == df.columns
    taken, want = defaultdict(int), {r.source: r.target for r in mixing.mix(df).collect()}
    for r in out.collect():
        assert (r.n, r.row, r.times) == (1, "x", 2) and rows[r.number][:3] == (r.doc_id, r.text, r.source)
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)
    assert mixing.mixed_documents(spark, df.limit(0), "").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
