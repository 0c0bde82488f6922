import numpy as np

from fieldloom.llm import gridjoin


def brute(ids, x, labels, t):
    ok = [v is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0 and l is not None for v, l in zip(x, labels)]
    n, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if ok[a] and ok[b] and labels[a] == labels[b] and len(x[a]) == len(x[b]):
                u, v = np.asarray(x[a], float), np.asarray(x[b], float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= t:
                    n[ids[a]] += 1
                    n[ids[b]] += 1
                    r, s = find(ids[a]), find(ids[b])
                    parent[max(r, s)] = min(r, s)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "LEAF", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 12))
    x = [(base[i % 40] + rng.normal(size=12) * (0.1 if i % 3 else 0.3)).astype("float32").tolist() for i in range(400)]
    labels = [int(v) for v in rng.integers(0, 3, 400)]
    x += [[3.0] * 12] * 30 + [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0]]
    labels += [1] * 35 + [1, 1, None]
    ids = [int(v) for v in rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v, l, "z") for i, v, l in zip(ids, x, labels)] + [(ids[0], x[0], labels[0], "z")], "vec_id long, embedding array<float>, label int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in gridjoin.near_duplicates(df).collect()}
    assert got == brute(ids, x, labels, 0.98)
    assert gridjoin.near_duplicates(df.limit(0)).count() == 0


def test_recursion_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    eps = np.sqrt(2 - 2 * 0.98)
    x = x[np.lexsort(np.floor(x[:, :4] / eps).T[::-1])]
    counts, head, tail = gridjoin.join_sequences(x, x[:, :4], x, x[:, :4], 0.98, eps, True)
    s = x @ x.T >= 0.98
    np.fill_diagonal(s, False)
    assert (counts == s.sum(1)).all()
    i, j = np.nonzero(s)
    assert (gridjoin.np_components(3000, i, j) == gridjoin.np_components(3000, head, tail)).all()
    c2, h2, t2 = gridjoin.join_sequences(x[:1000], x[:1000, :4], x[1000:], x[1000:, :4], 0.98, eps, False)
    assert (c2[:1000] == s[:1000, 1000:].sum(1)).all() and (c2[1000:] == s[1000:, :1000].sum(1)).all()


def test_boxes_skip_most_parts_of_clustered_vectors():
    """64-d vectors in 100 clusters: under a fifth of the pairs of parts are compared, and no link is lost."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 64))
    x = np.repeat(centres, 80, 0) + 0.08 * rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    epsilon = 0.2 * (1 + 1e-9)
    p = gridjoin._project(x, np.ascontiguousarray(vt[: gridjoin.AXES].T))
    order = np.lexsort(np.floor(p[:, : gridjoin.AXES] / epsilon).T[::-1])
    x, p = x[order], p[order]
    parts = list(gridjoin.near_parts(p, p, epsilon, True))
    side = len({a for a, *_ in parts})
    assert len(parts) < 0.2 * side * (side + 1) / 2
    near = np.triu(x @ x.T >= 0.98, 1)
    found = np.zeros_like(near)
    for a, b, c, d in parts:
        found[a:b, c:d] = True
    assert near.sum() > 1000 and not (near & ~found).any()
    assert np.triu(found).sum() < 0.2 * len(x) ** 2 / 2


def test_copies_are_one_row_with_a_count(spark):
    """A vector with very many copies, and others near it: links count every copy, and no group holds them all."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    x = [base] * 500 + [base * 2.0] * 3 + [base + 0.03 * rng.normal(size=8) for _ in range(20)] + [rng.normal(size=8) for _ in range(20)]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in gridjoin.near_duplicates(df).collect()}
    assert got == brute([r[0] for r in rows], [r[1] for r in rows], [1] * len(rows), 0.98)
    assert gridjoin._distinct(gridjoin._valid(df)).count() <= 42


def test_weights_count_as_copies():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.integers(1, 5, 200)
    counts, _, _ = gridjoin.join_sequences(x, x, x, x, 0.98, np.sqrt(0.04) * (1 + 1e-9), True, w)
    s = x @ x.T >= 0.98
    np.fill_diagonal(s, False)
    assert (counts == s @ w).all()


def test_runs_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "RUN_BYTES", 8 * 8 * 40)
    rng = np.random.default_rng(8)
    x = [(rng.normal(size=8) * 0.02 + np.ones(8)).tolist() for _ in range(300)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in gridjoin.near_duplicates(df).collect()}
    assert got == brute(list(range(300)), x, [1] * 300, 0.98)


def test_projection_never_lengthens():
    rng = np.random.default_rng(5)
    for dim in (3, 16, 40):
        x = rng.normal(size=(50, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : gridjoin.AXES]
        for b in (None, basis):
            p = gridjoin._project(x, b)
            assert p.shape == (50, gridjoin.AXES + 1)
            gap = np.linalg.norm(p[:, None] - p[None], axis=2) - np.linalg.norm(x[:, None] - x[None], axis=2)
            assert gap.max() < 1e-12
