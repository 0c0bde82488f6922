import hashlib
import random

import numpy as np

from fieldloom.llm import minhash as mh


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioutnsr") for _ in range(rng.randint(1, 6))) for _ in range(n))


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_signatures_follow_their_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 6, 30, 400):
        a, b = prose(rng, n), prose(rng, rng.choice([0, 2, 50]))
        own, other = mh.signatures(a, b)
        assert (own == mh.signature(a)).all() and (other == mh.signature(mh.edited(a, b))).all()


def test_likeness_estimates_jaccard():
    rng, off = random.Random(2), []
    for _ in range(60):
        w = prose(rng, 300).split()
        v = list(w)
        for _ in range(rng.randint(0, 40)):
            v[rng.randrange(300)] = "zz"
        a, b = " ".join(w), " ".join(v)
        off.append(mh.likeness(mh.signature(a), mh.signature(b)) - len(grams(a) & grams(b)) / len(grams(a) | grams(b)))
    assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < 0.2


def test_rows_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 4, 80])) if i % 9 else None, "x") for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = {r.doc_id: r for r in mh.with_next(df.repartition(3)).collect()}
    texts = {i: t or "" for i, t, _ in rows}
    assert len(got) == 60
    for i, t in texts.items():
        after = texts[(i + 1) % 60]
        e = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert r.n_chars == len(t) and bytes(r.edited_sha256) == hashlib.sha256(e.encode()).digest()
        s, x, n = (mh.signature(v) for v in (t, e, after))
        assert (bytes(r.fingerprint), bytes(r.edited_fingerprint)) == (s.tobytes(), x.tobytes())
        assert (r.near_edited, r.near_next) == (mh.likeness(s, x), mh.likeness(s, n))
    assert mh.with_next(df.limit(0)).count() == 0
    assert mh.with_next(df.limit(1)).first().near_next == 1.0


def test_long_unrelated_texts_are_unlike():
    rng = random.Random(3)
    a, b = (mh.signature(prose(rng, 20_000)) for _ in range(2))
    assert mh.likeness(a, b) < 0.05 and mh.likeness(a, a) == 1


def test_blocks_link_what_all_pairs_link(spark):
    """A chain of near copies whose ends are far apart, in blocks of a few texts."""
    rng, rows = random.Random(6), []
    for g in range(3):
        w = prose(rng, 150).split()
        for k in range(30):
            w = list(w)
            for j in rng.sample(range(30), rng.choice([0, 1, 1, 2])):
                w[j * 5 + rng.randrange(5)] = f"zz{k}"
            rows.append((g * 100 + k, " ".join(w)))
    rows += [(500 + i, t) for i, t in rows[:5]] + [(900, ""), (901, None), (902, "one"), (903, "one"), (904, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {bytes(r.text_key): (r.component_id, r.group_size) for r in mh.near_groups(mh.with_next(docs), docs, chunk=4).collect()}
    texts = sorted({t or "" for _, t in rows})
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    groups = {}
    for i, t in rows:
        groups.setdefault(label[texts.index(t or "")], []).append(i)
    want = {hashlib.sha256(t.encode()).digest()[:16]: (min(g), len(g)) for t, g in ((t, groups[x]) for t, x in zip(texts, label)) if len(g) > 1}
    assert got == want and len(set(want.values())) > 4


def test_query_links_near_copies(spark, tmp_path):
    rng, rows = random.Random(8), []
    for g in range(6):
        w = prose(rng, 120).split()
        for k in range(12):
            v = list(w)
            for j in range(k):
                v[(j * 7 + g) % 120] = f"zz{j}"
            rows.append((1000 * (k + 1) + g, " ".join(v)))  # near copies are never the next document
    lone = prose(rng, 60)
    rows += [(9_000_001 + i, t) for i, t in rows[:4]] + [(None, rows[7][1]), (None, lone), (None, lone), (None, " "), (None, None), (3, ""), (4, "one"), (5, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = sorted({t or "" for _, t in rows})
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i, t in rows:
        groups.setdefault(find(texts.index(t or "")), []).append((i, len(t or "")))
    want = []
    for group in groups.values():
        low = min((i for i, _ in group if i is not None), default=None)
        want += [(str(i), n, str(low), len(group)) for i, n in group]
    got = mh.op6_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_chars, str(r.component_id), r.group_size) for r in got) == sorted(want)
    assert max(n for *_, n in want) > 4
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert mh.op6_fingerprints(spark, f"{tmp_path}/none").count() == 0
