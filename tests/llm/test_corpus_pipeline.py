import random
import zlib
from collections import Counter

import pytest
import sentencepiece

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from fieldloom.llm import mixing, quality, simhash  # noqa: E402

LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def documents():
    """Good and bad texts of several sources, with copies, near copies, nulls, repeated ids and columns with the stages' own names."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(400):
        good = i % 4 != 0
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 90))]
        text = " ".join(words) + "." if good else "$$$ ||| " * 20 + " ".join(words[:5]).upper() + "!!!"
        rows.append((i, text, "abc"[min(2, i % 5)] if i % 7 else None))
        labels.append((i, int(good)))
    rows += [(1000 + i, rows[i][1], "a") for i in range(0, 60)]  # copies
    rows += [(2000 + i, rows[i][1] + " end", "b") for i in range(1, 40, 4)]  # near copies or not, as the fingerprint says
    rows += [(1, rows[301][1], "c"), (None, rows[2][1], "a"), (None, rows[303][1] + " new words here", "c"), (None, None, "a"), (3000, "", None)]
    return rows, labels


def plain(rows, good, spark):
    """The four stages in plain Python: what is kept after each, and the ids at the end."""
    rows = [r for r in rows if good(r[1])]
    fps = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                label = [label[b] if x == label[a] else x for x in label]
    first = {}
    for r, x in zip(rows, label):
        if x not in first or (r[0] is None, r[0] or 0) < (first[x][0] is None, first[x][0] or 0):
            first[x] = r
    return list(first.values())


def test_run_is_the_stages_in_plain_python(spark, tmp_path):
    rows, labels = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS n", "text AS row", "1 AS times", "'x' AS score")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "mixing", "pieces"]

    model = quality.fit(df.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int"))

    def good(text):
        at = dict(zip(quality.STATISTICS, quality.measure(text)))
        return model.bias + sum(r.weight for r in model.rules if all((at[k] > x) if above else (at[k] <= x) for k, above, x in r.terms)) >= 0

    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    kept = stages["quality"](spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in rows if good(r[1]))
    held = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(good(rows[i][1]) == bool(y) for i, y in held.items()) / len(held) > 0.95
    one = stages["simhash"](spark, kept, str(tmp_path))
    want = plain(rows, good, spark)
    assert one.columns == df.columns and Counter(r.doc_id for r in one.collect()) == Counter(r[0] for r in want)

    ends = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {}
    for i, t, _ in want:
        texts.setdefault(i, []).append(LIB.encode(t or ""))
    assert all(r.ids in texts[r.doc_id] for r in ends)
    # each row as often as the mix takes it, its last, cut one rounded
    plan = Counter()
    for r in mixing.mix(spark.createDataFrame(want, "doc_id long, text string, source string")).collect():
        plan[r.doc_id] += 1 if r.size == 0 else int(r.taken / r.size + 0.5)
    assert Counter(r.doc_id for r in ends) == +plan


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
