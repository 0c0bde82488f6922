import random

import pytest
import sentencepiece

public_tokenizers = pytest.importorskip("public_tokenizers")
from fieldloom.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
M = pieces.model()

SAMPLES = ["", " ", "a", "Hello  world\n\tx ▁y <s> <0x41>", "é日本 🤣\x00z ", "   lead", "trail   ", "aaaaaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x",
           "http://www.example.com/path?query=aGVsbG8gd29ybGQ=&x=1234567890", "THE!! THE!! ononon", "int main(){\n    return 0;\n}"]


def noise(rng, n):
    kinds = ["abcdeth inronst ", "aA1_-./=\n", "   \n\tx", "日本語éàüß🤣 z", "ththththeerer", "0123456789abcdef"]
    return "".join(rng.choice(rng.choice(kinds)) for _ in range(n))


def test_equals_library():
    rng = random.Random(1)
    for text in SAMPLES + [noise(rng, rng.randint(1, 300)) for _ in range(1500)]:
        assert M.encode(text) == LIB.encode(text), text
        assert M.decode(LIB.encode(text)) == LIB.decode(LIB.encode(text))


@pytest.mark.parametrize("chunk", [1, 3, 7, 40])
def test_chunks_equal_whole(chunk, monkeypatch):
    monkeypatch.setattr(pieces, "SNAP", 0)
    rng = random.Random(chunk)
    texts = [x for x in SAMPLES if x] + [noise(rng, rng.randint(1, 160)) for _ in range(150)] + ["".join(rng.choice("theronansti") for _ in range(200)) for _ in range(40)]
    for text in texts:
        normal = pieces.SPACE + text.replace(" ", pieces.SPACE)
        cuts = M.cuts(normal, chunk)
        pairs = list(zip(cuts, cuts[1:]))
        matrices = [M.transfer(normal, a, b) for a, b in pairs]
        states = pieces.cut_states(matrices)
        got = []
        for (a, b), come, go in zip(pairs, [0, *states], states):
            got += M.backtrace(normal, a, b, come, go)
        assert got == LIB.encode(text), (text, cuts)


def test_scan_is_the_product_of_prefixes():
    import numpy as np

    rng = np.random.default_rng(3)
    ms = [rng.normal(size=s) for s in ((1, 4), (4, 3), (3, 5), (5, 2), (2, 1))]
    want, out = ms[0], [ms[0]]
    for m in ms[1:]:
        want = pieces.max_plus(want, m)
        out.append(want)
    assert all(np.allclose(a, b) for a, b in zip(pieces.scan(ms), out))


def test_operator(spark):
    rng = random.Random(9)
    giant = "".join(rng.choice("theronansti") for _ in range(1500))
    rows = [(1, "plain text here", "x"), (2, None, "x"), (3, "", None), (None, "no id", "x"), (5, giant, "x"), (5, giant, "x"), (7, noise(rng, 2000), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode(df, giant=300, chunk=97)
    assert got.columns == ["doc_id", "ids"]
    want = sorted((str(i), LIB.encode(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == want
    import zlib

    import numpy as np

    more = pieces.encode(df, giant=300, chunk=97, more=pieces._digests, more_schema="n_tokens long, ids_crc32 long, decoded_crc32 long").collect()
    assert sorted((str(r.doc_id), r.ids) for r in more) == want
    for r in more:
        assert (r.n_tokens, r.ids_crc32, r.decoded_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()), zlib.crc32(LIB.decode(r.ids).encode()))
    back = pieces.decode(got).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), LIB.decode(LIB.encode(t or ""))) for i, t, _ in rows)
    assert pieces.encode(df.limit(0)).count() == 0


def test_words_in_use_are_made_once(monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE", 50)
    rng = random.Random(4)
    own = pieces.PieceModel(PATH)
    made = []
    own._segment.make = lambda segment: made.append(segment) or own._encode_segment(segment)
    words = ["qx" + "".join(rng.choice("theronansti日ß") for _ in range(rng.randint(1, 30))) + rng.choice(["", ",", "..", "1"]) for _ in range(900)]
    for a, b, c in zip(words[::3], words[1::3], words[2::3]):
        text = f"and {a} and {b} and, {c}"
        assert own.encode(text) == LIB.encode(text), text
    assert made.count("▁and") == made.count("▁and,") == made.count(",") == 1
