import random

import pytest

from fieldloom.operators import link

WORDS = ["ramesh", "kumar", "sharma", "anita", "suresh", "patel", "ramesha", "kumari", "anit", "a", "li", "das"]


def brute_grams(name):
    line = " " + " ".join(sorted(name.split())) + " "
    return {line[i : i + 2] for i in range(len(line) - 1)} if name.strip() else set()


def similarity(a, b):
    x, y = brute_grams(a), brute_grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize(("least", "hot"), [(0.6, 4096), (0.6, 2), (0.35, 3), (1.0, 1)])
def test_names_are_brute_force(spark, least, hot):
    rng = random.Random(7)
    side = lambda n: [" ".join(rng.choice(WORDS) + rng.choice(["", "", "h", "x"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    left, right = side(60) + ["", " ", None], side(60) + ["", None]
    left += left[:5]
    got = link.alike_names(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "name string"), least, hot).collect()
    want = {(a, b): similarity(a, b) for a in left if a for b in right if b if similarity(a, b) >= least - 1e-9}
    assert {(r.name, r.other): round(r.jaccard, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(got) == len(want)


def test_documents_find_their_forms(spark):
    docs = [(1, "Ramesh Kumar", "19/04/2001"), (2, "रमेश कुमार", "2001-04-19"), (3, "Ramesh Kumar", "20/04/2001"), (4, None, "19/04/2001"), (5, "Ramesh Kumar", None), (6, "", "x"), (1, "Ramesh Kumar", "19/04/2001")]
    forms = [("a", "KUMAR, Ramesh", "19 Apr 2001"), ("b", "Ramesh Kumarh", "19-04-2001"), ("c", "Somebody Else", "19-04-2001"), (None, "Ramesh Kumar", "20-04-2001")]
    d, f = spark.createDataFrame(docs, "doc_key int, name string, dob string"), spark.createDataFrame(forms, "form_key string, name string, dob string")
    got = sorted((r.doc_key, str(r.form_key)) for r in link.linked(d, f).collect())
    assert got == sorted([(1, "a"), (1, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "None")])
    every = {(r.doc_key, r.form_key, r.name_score) for r in link.linked(d, f, least=0.3).collect()}
    some = {(r.doc_key, r.form_key, r.name_score) for r in link.linked(d, f, least=0.3, score_least=0.97).collect()}
    assert some == {r for r in every if r[2] >= 0.97} and (1, "a") in {r[:2] for r in every}
    assert link.linked(d.limit(0), f).count() == 0 and link.linked(d, f.limit(0)).count() == 0


def test_names_are_paired_within_a_day(spark):
    rng = random.Random(3)
    side = lambda: [(" ".join(rng.choice(WORDS) for _ in range(2)), rng.choice("xyz")) for _ in range(40)]
    left, right = side(), side()
    got = link.alike_names(*(spark.createDataFrame(rows, "name string, born string") for rows in (left, right)), 0.5, 2, on=("born",)).collect()
    want = {(a, b, d) for a, d in left for b, e in right if d == e and similarity(a, b) >= 0.5 - 1e-9}
    assert {(r.name, r.other, r.born) for r in got} == want and len(got) == len(want)


def broadcast_rows(spark, after):
    """Rows of each table that was broadcast by queries numbered over `after`, and the last query's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    queries = [q.executionId() for q in listed(store.executionsList())]
    for q in [q for q in queries if q > after]:
        values = listed(store.executionMetrics(q))
        for node in listed(store.planGraph(q).allNodes()):
            if node.name().startswith("BroadcastExchange"):
                rows += [int(values[m.accumulatorId()].replace(",", "")) for m in listed(node.metrics()) if m.name() == "number of output rows" and m.accumulatorId() in values]
    return rows, max(queries, default=-1)


def test_names_are_not_broadcast(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice("bcdfg") for _ in range(2)), f"{i % 28 + 1}/1/2001") for i in range(300)]
    d, f = spark.createDataFrame(rows, "doc_key int, name string, dob string"), spark.createDataFrame(rows, "form_key int, name string, dob string")
    _, last = broadcast_rows(spark, -1)
    found = link.linked(d, f).select("doc_key", "form_key").collect()
    sent, _ = broadcast_rows(spark, last)
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and similarity(a[1], b[1]) >= 0.6 - 1e-9}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    # the order of grams, and the grams of over 4096 names: none here
    assert sent and max(sent) == 1


def test_grams_are_of_any_characters(spark):
    names = ["a", "ab ba", "\U0001d7d8\U0001f600x", "é\U0001f600 \U0001f600é", "\x00a", "名前", " ", "", "aaa"]
    rows = spark.createDataFrame([(x,) for x in names], "name string").select("name", link.grams(link.F.col("name")).alias("grams")).collect()
    for r in rows:
        assert sorted(chr(g >> 21) + chr(g % (1 << 21)) for g in r.grams) == sorted(brute_grams(r.name))
    got = link.alike_names(*[spark.createDataFrame([(x,) for x in names], "name string")] * 2, 0.3).collect()
    assert {(r.name, r.other): round(r.jaccard, 9) for r in got} == {(a, b): round(similarity(a, b), 9) for a in names for b in names if similarity(a, b) >= 0.3 - 1e-9}
