import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from fieldloom.llm import tokenfiles as tf  # noqa: E402

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def noise(rng, n):
    return "".join(rng.choice(["the", "Ärger", " ", "\n", "'s", "it's", "12", "\x1c", " ", "é", "́", "!?", "日本", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "The,", "(x-1", "e.", "\x85", "İ", "Σ "]) for _ in range(n))


def test_words_equal_whole_texts():
    rng, words = random.Random(3), tf._Words(None)
    for text in ["", " ", None] + [noise(rng, rng.randint(1, 60)) for _ in range(600)]:
        assert np.frombuffer(words.ids([text and text.encode()])[0], "<u4").tolist() == TOK.encode(text or "", add_special_tokens=False).ids + [1], repr(text)
    texts = [noise(rng, 40) for _ in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.ids([t.encode() for t in texts])] == [TOK.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_format_and_checksums():
    out = io.BytesIO()
    w = tf.FrameWriter(out)
    docs = [(5, b"abcd" * 9), (None, b"\x01\0\0\0"), (-3, bytes(4000))]
    for d in docs:
        w.add(*d)
    w.close()
    raw = out.getvalue()
    r = tf.FrameReader(io.BytesIO(raw))
    assert [(r.doc_id(i), r.content(i)) for i in (2, 0, 1)] == [docs[i] for i in (2, 0, 1)]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(c for _, c in docs)
    at = int(r.starts[2] + r.sizes[2][0]) - 2
    some = tf.FrameReader(io.BytesIO(raw), 1, 3, int(r.starts[1]))
    assert [(some.doc_id(i), some.content(i)) for i in (2, 1)] == [docs[i] for i in (2, 1)]
    bad = tf.FrameReader(io.BytesIO(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.content(2)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SPAN", 4)
    rng = random.Random(8)
    rows = [(i * 7 % 41, noise(rng, 30), "x") for i in range(41)] + [(None, "no id", None), (3, "twice", None), (60, None, None), (61, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tf.read_files(tf.write_files(df, f"file://{tmp_path}/x")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    texts, at = {}, 0
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(tuple(TOK.encode(t or "", add_special_tokens=False).ids + [1]))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in texts[r.doc_id]}
    assert tf.read_files(tf.write_files(df.limit(0), f"file://{tmp_path}/y")).count() == 0
