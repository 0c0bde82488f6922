import random
from collections import Counter

import numpy as np

from fieldloom.llm import lmscore as lm


def logs(p, c, t):
    return lm.log_probabilities(p, lm.tables_of(p), c, t)


def loss(p, c, t):
    return -logs(p, c, t).mean()


def test_probabilities_sum_to_one():
    p = lm.start_parameters()
    context = np.tile(np.array([[5, 9, 70, 900]]), (lm.SIDE**2, 1))
    every = logs(p, context, np.arange(lm.SIDE**2))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    # by hand, for one word
    t = 3 * lm.SIDE + 7
    h = np.tanh(p["e"][context[0]].ravel() @ p["w"] + p["b"])
    zc, zw = h @ p["c"] + p["cb"], h @ p["u"][3] + p["ub"][3]
    assert abs(every[t] - (zc[3] - np.log(np.exp(zc).sum()) + zw[7] - np.log(np.exp(zw).sum()))) < 1e-4


def test_step_follows_the_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in lm.start_parameters().items()}
    c, t = rng.integers(0, 300, (64, 4)), rng.integers(0, 300, 64)
    q = {k: v.copy() for k, v in p.items()}
    lm.step(q, c, t, 1e-3)
    for k, at in (("w", (3, 5)), ("c", (4, 2)), ("b", (7,)), ("cb", (1,))):
        hi, lo = {n: v.copy() for n, v in p.items()}, {n: v.copy() for n, v in p.items()}
        hi[k][at] += 1e-4
        lo[k][at] -= 1e-4
        slope = (loss(hi, c, t) - loss(lo, c, t)) / 2e-4
        assert abs((p[k][at] - q[k][at]) / 1e-3 - slope) < 1e-3, k
    assert loss(q, c, t) < loss(p, c, t)


def corpus(rng, n):
    chain = {w: [rng.choice(range(40)) for _ in range(3)] for w in range(40)}
    out = []
    for i in range(n):
        w, words = rng.randrange(40), []
        for _ in range(60):
            w = rng.choice(chain[w])
            words.append(f"w{w}")
        out.append((i, " ".join(words)))
    return out


def scored(df, p=None, **how):
    encoded = lm.encode(df)
    p = p or lm.train(encoded, **how)
    return {r.doc_id: r for r in lm.score(encoded, p).collect()}, p


def brute(rows, p):
    """Log-probability of each text, word by word."""
    counts = Counter(w for _, t in rows for w in lm.words_of(t))
    kept = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.KEPT])}
    id_of = {w: kept.get(w, lm.bucket_of(w)) for w in counts}
    places = Counter()
    for w, n in counts.items():
        places[id_of[w]] += n
    for i, t in rows:
        words, want = lm.words_of(t), 0.0
        ids = np.array([lm.PAD] * 2 + [id_of[w] for w in words] + [lm.PAD] * 2)
        for k, w in enumerate(words):
            want += logs(p, lm.windows(ids)[k : k + 1], ids[k + 2 : k + 3])[0]
            want += np.log(counts[w] / places[id_of[w]]) if id_of[w] >= lm.KEPT else 0
        yield i, len(words), want


def test_learns_order_and_scores_whole_documents(spark):
    rng = random.Random(7)
    rows = corpus(rng, 1500)
    shuffled = []
    for i, t in rows[:100]:
        w = t.split()
        rng.shuffle(w)
        shuffled.append((10_000 + i, " ".join(w)))
    extra = [(20_000, None), (20_001, ""), (None, "w1 w2 never seen"), (20_002, " ".join(["w1"] * 70_000))]
    every = [(i, t, 0) for i, t in rows + shuffled + extra]
    df = spark.createDataFrame(every, "doc_id long, text string, n_words int").repartition(3)
    got, p = scored(df)
    straight = np.mean([got[i].mean_log_prob for i, _ in rows[:100]])
    assert straight > np.mean([got[i].mean_log_prob for i, _ in shuffled]) + 0.1
    assert got[20_002].n_words == 70_000 and (got[20_000].n_words, got[20_000].log_prob, got[20_001].mean_log_prob) == (0, 0.0, None)
    none = lm.encode(df.limit(0))
    assert lm.score(none, p).count() == 0 and lm.train(none)["e"].shape == lm.SHAPES["e"]


def test_training_is_one_process_training_whatever_the_partitions(spark):
    """Against the same rounds and shards in one process, with more shards than are added up at once."""
    rows = corpus(random.Random(5), 300) + [(7, None), (None, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = lm.encode(df.repartition(20))
    p = lm.train(encoded, rounds=2, shard_words=450)
    dealt = encoded.where("n_words > 0").selectExpr("doc_id", "ids", "n_words", "xxhash64(doc_id, ids) AS h", "xxhash64(ids) AS g").collect()
    shards, q = -(-sum(r.n_words for r in dealt) // 900), lm.start_parameters()
    assert shards > lm.FAN_IN
    for k in range(2):
        total, sums = 0, 0
        for s in range(shards):
            own = sorted((r for r in dealt if r.h % 2 == k and int(np.floor(r.h / 2)) % shards == s), key=lambda r: (r.g, r.doc_id is not None, r.doc_id))
            if own:
                one = {n: v.copy() for n, v in q.items()}
                n = lm.train_shard([r.asDict() for r in own], one, lm.RATE / (1 + k) ** 0.5)
                total, sums = total + n, sums + lm.flat(one).astype(float) * n
        q = lm.unflat(sums / total)
    assert max(np.abs(p[n] - q[n]).max() for n in p) < 1e-4
    again = lm.train(lm.encode(df.repartition(2)), rounds=2, shard_words=450)
    assert max(np.abs(p[n] - again[n]).max() for n in p) < 1e-4


def test_every_count_reaches_the_score(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3500) for _ in range(1 + 1500 // (i + 20))]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)] + ["w900 w3499 w3499 w100", None, ""]
    rows, p = list(enumerate(texts)), lm.start_parameters()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for flush in (lm._FLUSH, 700):  # one segment a partition, and several
        got = {r.doc_id: r for r in lm.score(lm.encode(df, flush), p).collect()}
        assert len(got) == len(texts)
        for i, n, want in brute(rows, p):
            assert got[i].n_words == n and abs(got[i].log_prob - want) < 1e-2
            assert got[i].mean_log_prob is None if not n else abs(got[i].mean_log_prob * n - got[i].log_prob) < 1e-9
