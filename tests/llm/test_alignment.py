import hashlib
import random
from collections import Counter

import pytest

from fieldloom.llm import alignment


def whole(p, text):
    """(A ids, B ids, groups, links) of a whole text by the libraries; None if it has no tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
    if b"".join(p.raw_a[i] for i in a) != raw or b"".join(p.raw_b[i] for i in b) != raw:
        return None
    spans = []
    for ids, raws in ((a, p.raw_a), (b, p.raw_b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(raws[i]), i))
            at += len(raws[i])
        spans.append(own)
    ends = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
    groups, at = [], 0
    for end in ends:
        groups.append(tuple(tuple(i for x, y, i in own if at <= x and y <= end) for own in spans))
        at = end
    links, j = [], 0
    for x, y, i in spans[0]:
        while spans[1][j][1] <= x:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < y:
            links.append((i, spans[1][k][2]))
            k += 1
    return a, b, groups, links


def brute(p, texts):
    got = [whole(p, t) for t in texts]
    counts = Counter(link for g in got if g for link in g[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for g in got:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = g
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_texts(rng, n):
    bits = [" ", "  ", "\n", "\r", "\r\n", "\t", " ", "　", "\x1c", "\x85", "\v", "a", "the", "Word", "don't", "'s", "123", "1", ";", "();", "}", "é", "中文", "ไทย", "🙂", "​", "\x00", "<|endoftext|>", "<s>", "<0x0A>", "_", ".", "…", "www", "ﬁ", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize(("broadcast", "pairs", "block"), [(200_000, 2_000_000, 1 << 25), (7, 2_000_000, 500), (0, 0, 1)])
def test_documents_are_brute_force(spark, tmp_path, broadcast, pairs, block):
    rng = random.Random(broadcast + block)
    texts = odd_texts(rng, 150) + ["the cat sat " * 40, "a▁b c", "▁", " ", "  ", "\n", "x ", None, "", "the cat" + " " * 50 + "\n\nsat", "z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df.write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    got = alignment.align_documents(df, broadcast=broadcast, block=block, most_pairs=pairs, groups=True).collect()
    p = alignment.pair((None, None))
    want = brute(p, texts)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], texts[r.doc_id]
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
    assert len(got) == len(texts)


def test_cuts_are_safe():
    """Tokens of whole texts are those of their segments, one after another."""
    p, rng = alignment.pair((None, None)), random.Random(8)
    assert "\r" not in p.splits and " " in p.splits and "\n" in p.splits
    for text in odd_texts(rng, 2000):
        segments = p.cut(text)
        assert "".join(segments) == " " + text
        got = p.align(segments)
        a, b = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
        groups = ";".join(x.groups for x in got).split(";")
        assert [int(i) for g in groups for i in g.split("|")[0].split(",")] == a and [int(i) for g in groups for i in g.split("|")[1].split(",")] == b
        assert [p.align([s])[0] for s in segments] == got


def test_edge_cases(spark):
    rows = [(1, "one two", 5, "k"), (1, "one two", 5, "k"), (None, "one", 5, "k"), (None, None, 5, "k"), (2, "", 5, "k"), (3, "one ▁", 5, "k"), (4, "one two three " * 200, 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a long, groups string")
    got = alignment.align_documents(df).collect()
    want = brute(alignment.pair((None, None)), [r[1] for r in rows])
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert alignment.align_documents(df.limit(0)).count() == 0
    assert alignment.align_documents(df.where("doc_id = 2")).first().n_links == 0
