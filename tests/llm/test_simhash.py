import random

import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import common, mixing, simhash


def brute(text):
    words = (text or "").encode()
    words = words.lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint_is_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 17, 200):
        for _ in range(10):
            text = rng.choice([" ", "\n", "\t  "]).join("".join(rng.choice("aBé\x1c ") for _ in range(rng.randint(1, 4))) for _ in range(n))
            assert simhash.fingerprint(text) & (1 << 64) - 1 == brute(text)
    assert simhash.fingerprint(None) == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_groups_are_brute_force(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    want = {(signed(a), signed(b)) for a in fps for b in fps if a != b and bin(a ^ b).count("1") <= 3}
    assert {(min(p), max(p)) for p in got} == {(min(p), max(p)) for p in want}
    parent = {signed(x): signed(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {signed(x): i for i, x in enumerate(rng.sample(fps, len(fps)))}
    low = {}
    for x, i in ids.items():
        low[find(x)] = min(low.get(find(x), i), i)
    docs = spark.createDataFrame([(i, x) for x, i in ids.items()] + [(10_000 + i, x) for x, i in ids.items()], "doc_id long, fp long")
    assert {r.fp: r.component_id for r in simhash.groups(docs).collect()} == {x: low[find(x)] for x in ids}


def test_edge_cases(spark):
    rows = [(1, "other words altogether", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "a b c", "s"), (None, "q w e r t y", "s"), (4, "A  B\nC", "s")]
    # two groups have rows of id 1, one of the two rows without id is alone
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((str(r.doc_id), r.fp == 0, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([("1", False, 1), ("1", False, 1), ("1", False, 1), ("2", True, 2), ("3", True, 2), ("None", False, 1), ("None", False, None), ("4", False, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "1", "2", "None"]
    clash = df.selectExpr("*", "'k' AS n", "doc_id AS row", "text AS tie", "1.5 AS label")
    again = simhash.keep_one(spark, clash, "")
    assert again.columns == clash.columns and {(r.n, r.label) for r in again.collect()} == {("k", 1.5)}
    assert simhash.keep_one(spark, df.limit(0), "").count() == 0


def test_kept_rows_are_found_without_a_shuffle_of_texts(spark):
    """Whatever the number of rows: a bit a number is broadcast where the numbers themselves would be too large."""
    rng = random.Random(8)
    rows = [(i, " ".join("%x" % rng.getrandbits(40) for _ in range(12))) for i in range(6000)]
    df = spark.createDataFrame(rows + [(i + 9000, t) for i, t in rows[:50]], "doc_id long, text string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
        one = simhash.keep_one(spark, df, "")
        twice = mixing.mixed_documents(spark, df.selectExpr("*", "'abc' as source"), "")
        assert sorted(r.doc_id for r in one.collect()) == [i for i, _ in rows]  # the copies have larger ids
        assert twice.count() == len(rows) + 50
        for got in (one, twice):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_marks_are_the_numbers_given(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 1 << 33, (1 << 33) + 5, (7 << 33) + 40_000]
    rows = spark.createDataFrame([(n + d,) for n in numbers for d in (0, 1, 2)], "n long").distinct()
    some = spark.createDataFrame([(n, n % 2 == 1) for n in numbers], "n long, odd boolean")
    got = common.marked(rows, common.pages(some, "some", all=F.lit(True), odd=F.col("odd"))).collect()
    assert sorted(r.n for r in got if r.all) == numbers
    assert sorted(r.n for r in got if r.odd) == [n for n in numbers if n % 2 == 1]
