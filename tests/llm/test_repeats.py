import hashlib
import random
import re
from collections import Counter

import pytest

from fieldloom.llm import repeats


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, window):
    split = [words_of(t) for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), " ".join(left)))
    return out


def corpus(rng, n, vocabulary, shared):
    """Texts of random words with passages of `shared`, near copies, periodic stretches and other spacing."""
    texts = []
    for _ in range(n):
        words = []
        while len(words) < rng.choice((5, 30, 80, 200)):
            kind = rng.random()
            if kind < 0.4 and shared:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randint(5, len(p))]
            elif kind < 0.5:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(1, 3))] * rng.randint(2, 30)
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        if texts and rng.random() < 0.2:
            words = words_of(rng.choice(texts))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "new"
        texts.append(rng.choice((" ", "\n", "\t ")).join(words))
    return texts


@pytest.mark.parametrize(("window", "most", "names"), [(35, 128, 500), (12, 128, 6), (12, 2, 40), (9, 1, 3)])
def test_results_are_brute_force(spark, window, most, names):
    rng = random.Random(window * most + names)
    vocabulary = [f"w{i}é\x1c" if i % 7 == 0 else f"W{i}" for i in range(names)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for _ in range(6)]
    texts = corpus(rng, 120, vocabulary, shared) + [" ".join(shared[0] * 3), "a " * 300, "a " * window, "a " * (window - 1), None, ""]
    got = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), window, most)
    want = brute(texts, window)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()}
    assert rows == {i: w[:3] for i, w in enumerate(want)}
    assert any(w[1] for w in want) and (window < 35 or any(w[1] == 0 for w in want))


def test_edge_cases(spark):
    rng = random.Random(4)
    base = [f"x{i}" for i in range(60)]
    long = [rng.choice(base) for _ in range(60_000)]
    texts = [" ".join(base), " ".join(base), None, "", "one two", " ".join(long), " ".join(["p"] + base[:35]), " ".join(base[:34]), " ".join(f"u{i}" for i in range(90))]
    ids = [1, 1, 2, 3, None, 4, None, 5, None]
    rows = [(i, t, "k", 7) for i, t in zip(ids, texts)] + [(None, texts[0], "k", 7)] * 3 + [(None, texts[-1], "k", 7)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n long")
    got = repeats.without_repeats(df)
    want = brute([r[1] for r in rows], 35)
    key = lambda x: (str(x[0]), *map(str, x[1:]))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=key) == sorted(((r[0], *w[:3]) for r, w in zip(rows, want)), key=key)
    texts = repeats.kept_texts(df)
    assert sorted(((r.doc_id, r.text) for r in texts.collect()), key=key) == sorted(((r[0], w[3]) for r, w in zip(rows, want)), key=key)
    assert repeats.without_repeats(df.limit(0)).count() == 0
    # alone in the corpus, whatever its id, a text keeps all its words
    assert repeats.without_repeats(df.where("doc_id = 4")).first().n_removed == brute([texts_of(df)], 35)[0][1]


def texts_of(df):
    return df.where("doc_id = 4").first().text


def test_automaton_counts_places():
    rng = random.Random(1)
    for _ in range(60):
        held = [([rng.randrange(3) for _ in range(rng.randint(1, 14))], rng.randint(1, 2)) for _ in range(rng.randint(1, 5))]
        counts = Counter()
        for words, weight in held:
            for a in range(len(words)):
                for b in range(a + 1, len(words) + 1):
                    counts[tuple(words[a:b])] += weight
        automaton = repeats.Automaton()
        for words, weight in held:
            automaton.add(words, weight)
        again = automaton.settle()
        for words, _ in held:
            want = [max((e - a for a in range(e) if counts[tuple(words[a:e])] > 1), default=0) for e in range(1, len(words) + 1)]
            assert automaton.statistics(words, again) == want
        masks = repeats.shard_masks(held, 4)
        assert masks == [sum(1 << i for i in range(len(w) - 3) if counts[tuple(w[i : i + 4])] > 1) for w, _ in held]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    words = [rng.choice("abcd").encode() for _ in range(400)]
    text = repeats.Text(words)
    first, size, anchors = text.stretches(12)
    seen = {}
    for a, k, g in zip(first, size, anchors):
        for i in range(a, a + k):
            assert seen.setdefault(tuple(words[i : i + 12]), g) == g
    assert size.sum() == len(words) - 11
