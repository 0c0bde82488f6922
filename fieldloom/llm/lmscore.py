"""LM scoring: masked pseudo-likelihood by a window network trained in numpy.

A small network predicts every word from the two words before and the two after it. A document's score
is the sum of the conditional log-probabilities of all its words. Words are counted over the whole
corpus; the KEPT most frequent have ids of their own, all others share BUCKETS hashed ids. A hashed id's
probability is dealt out by the counts of its words, so that every word's count reaches the score. The
softmax has two levels (a class, then a word of the class), so a word costs 2 * SIDE outputs, not SIDE
squared.

Texts are read once. Each task cuts its documents into segments of at most _FLUSH different words,
numbers a segment's words in order of appearance and writes the documents as these numbers, and the
words with their counts. The counts are summed in Spark and joined back to the segments' words, so each
word of a segment, not of a document, crosses the network; a segment's documents then get the ids of
the network and what their rare words add to the score.

Training runs over every word of the corpus, once, in ROUNDS rounds: a round's documents are dealt to
shards of about SHARD_WORDS words by a hash of id and ids, every shard takes gradient steps from the
common parameters, and the results are averaged, weighted by their words, FAN_IN at a time. How the
table is partitioned doesn't matter. The KEPT words, two numbers a bucket and one set of parameters
(about 1 MB) are all that reaches the driver.

Defined cases: null and empty texts and texts without words have 0 words, a log-probability of 0 and a
null mean; repeated rows and null ids are rows of their own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, table

SIDE = 40  # classes, and words in each
BUCKETS = 512
KEPT = SIDE * SIDE - BUCKETS - 1
PAD = SIDE * SIDE - 1
WINDOW = 2
EMBED, HIDDEN = 16, 32
BATCH = 4096
RATE = 2.0
#: Rounds of one pass over the corpus, and words that a shard of a round holds.
ROUNDS = 4
SHARD_WORDS = 500_000
FAN_IN = 16
SLICE = 8192
#: Different words, and words, that a segment holds before it ends with the document.
_FLUSH, _LONGEST = 500_000, 4_000_000
#: Words of a segment that a row holds.
_SOME = 4096

SHAPES = {"e": (SIDE * SIDE, EMBED), "w": (2 * WINDOW * EMBED, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, SIDE), "cb": (SIDE,), "u": (SIDE, HIDDEN, SIDE), "ub": (SIDE, SIDE)}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket_of(word: bytes) -> int:
    return KEPT + zlib.crc32(word) % BUCKETS


class _Numbers(dict):
    """Words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def segments(docs: DataFrame, flush: int = _FLUSH) -> DataFrame:
    """(doc_id, text) to rows of documents (segment, doc_id, n_words, numbers) and of words (segment, first, words, counts),
    whose numbers are first, first + 1 and so on.
    """

    def make(rows):
        from pyspark import TaskContext

        segment, numbers, held = TaskContext.get().partitionId() << 33, _Numbers(), []

        def words():
            counts = np.bincount(np.concatenate(held), minlength=len(numbers)).tolist() if held else []
            every = list(numbers)
            for i in range(0, len(every), _SOME):
                yield {"segment": segment, "first": i, "words": every[i : i + _SOME], "counts": counts[i : i + _SOME]}

        total = 0
        for r in rows:
            got = np.array(list(map(numbers.__getitem__, words_of(r["text"]))), "<i4")
            held.append(got)
            total += len(got)
            yield {"segment": segment, "doc_id": r["doc_id"], "n_words": len(got), "numbers": zstandard.compress(got.tobytes(), 1)}
            if len(numbers) >= flush or total >= _LONGEST:
                yield from words()
                segment, total = segment + 1, 0
                numbers.clear()
                held.clear()
        yield from words()

    return materialise(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "segment long, doc_id long, n_words long, numbers binary, first int, words array<binary>, counts array<long>"), "segments")


def vocabulary(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The KEPT most frequent words, and the words' places in each bucket; all other counts stay in the table (word, n)."""
    kept = {bytes(r.word): r.n for r in counts.orderBy(F.desc("n"), "word").limit(KEPT).collect()}
    places = np.zeros(BUCKETS)
    for r in counts.groupBy((F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("places")).collect():
        places[r.bucket] = r.places
    for w, n in kept.items():
        places[bucket_of(w) - KEPT] -= n
    return list(kept), places


def encode(docs: DataFrame, flush: int = _FLUSH) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, ids, dealt): network ids as 16-bit numbers, and the sum over the words with hashed
    ids of the logarithm of a word's share of its bucket's places.
    """
    spark = docs.sparkSession
    parts = segments(docs, flush)
    zipped = parts.where("first is not null").select("segment", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    words = zipped.select("segment", (F.col("first") + F.col("at")).alias("number"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    kept, places = vocabulary(counts)
    own = F.broadcast(spark.createDataFrame([(bytearray(w), i) for i, w in enumerate(kept)], "word binary, own int"))  # KEPT rows at most
    known = counts.join(own, "word", "left").select("word", "n", F.coalesce("own", (F.crc32("word") % BUCKETS + KEPT).cast("int")).alias("id"))
    named = words.select("segment", "number", "word").join(known, "word").groupBy("segment").agg(F.collect_list(F.struct("number", "id", "n")).alias("all"))  # at most a segment's words
    named = named.select("segment", F.col("all.number").alias("number"), F.col("all.id").alias("id"), F.col("all.n").alias("times"))
    rows = parts.where("first is null").select("segment", "doc_id", "n_words", "numbers").unionByName(named, allowMissingColumns=True)
    log_places = np.log(np.maximum(1, places))

    def make(rows):
        ids = shares = np.zeros(0)
        for r in rows:
            if r["number"] is not None:
                ids, shares = np.zeros(len(r["number"]), "<u2"), np.zeros(len(r["number"]))
                ids[r["number"]] = r["id"]
                hashed = r["id"] >= KEPT
                shares[r["number"][hashed]] = np.log(r["times"][hashed]) - log_places[r["id"][hashed] - KEPT]
            else:
                numbers = np.frombuffer(zstandard.decompress(r["numbers"]), "<i4")
                yield {"doc_id": r["doc_id"], "n_words": r["n_words"], "ids": ids[numbers].tobytes() if len(numbers) else b"", "dealt": float(shares[numbers].sum()) if len(numbers) else 0.0}

    ordered = rows.repartition("segment").sortWithinPartitions("segment", F.col("number").isNull())
    encoded = materialise(map_rows(ordered, make, "doc_id long, n_words long, ids binary, dealt double", arrays=("number", "id", "times")), "encoded")
    for used in (parts, counts):
        discard(used)
    return encoded


def start_parameters() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    scale = {"e": 0.3, "w": 0.15, "c": 0.1, "u": 0.1}
    return {k: (rng.normal(size=s) * scale.get(k, 0)).astype(np.float32) for k, s in SHAPES.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def windows(ids: np.ndarray) -> np.ndarray:
    """Context ids of each place of one padded sequence (WINDOW pads on either side)."""
    n = len(ids) - 2 * WINDOW
    return np.stack([ids[k : k + n] for k in range(2 * WINDOW + 1) if k != WINDOW], 1)


def _logits(h: np.ndarray, p: dict[str, np.ndarray], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs for the words of each row's class, which rows must be sorted by, and where the classes begin."""
    edges = np.searchsorted(cls, np.arange(SIDE + 1))
    z = np.empty((len(h), SIDE), h.dtype)
    for k in range(SIDE):
        a, b = edges[k], edges[k + 1]
        if a < b:
            np.matmul(h[a:b], p["u"][k], out=z[a:b])
            z[a:b] += p["ub"][k]
    return z, edges


def _softmax(z: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the picked columns, and the exponentials (in z's place) with their sums."""
    z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), picked]
    np.exp(z, out=z)
    total = z.sum(1)
    return own - np.log(total), total


def hidden(tables: np.ndarray, b: np.ndarray, context: np.ndarray) -> np.ndarray:
    """tables: what each id adds at each place of the window."""
    h = tables[0][context[:, 0]]
    for k in range(1, 2 * WINDOW):
        h += tables[k][context[:, k]]
    h += b
    return np.tanh(h, out=h)


def tables_of(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([p["e"] @ p["w"][k * EMBED : (k + 1) * EMBED] for k in range(2 * WINDOW)])


def log_probabilities(p: dict[str, np.ndarray], tables: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the targets in their contexts."""
    order = np.argsort(target // SIDE, kind="stable")
    cls, word = np.divmod(target[order], SIDE)
    h = hidden(tables, p["b"], context[order])
    out = np.empty(len(target))
    out[order] = _softmax(h @ p["c"] + p["cb"], cls)[0] + _softmax(_logits(h, p, cls)[0], word)[0]
    return out


def step(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step down the mean negative log-likelihood of a batch, in place."""
    order = np.argsort(target // SIDE, kind="stable")
    context, (cls, word) = context[order], np.divmod(target[order], SIDE)
    n, at = len(context), np.arange(len(context))
    x = p["e"][context].reshape(n, -1)
    h = np.tanh(x @ p["w"] + p["b"])
    dc = h @ p["c"] + p["cb"]
    dw, edges = _logits(h, p, cls)
    for z, picked in ((dc, cls), (dw, word)):
        z /= _softmax(z, picked)[1][:, None]
        z[at, picked] -= 1
    dh = dc @ p["c"].T
    for k in range(SIDE):
        a, b = edges[k], edges[k + 1]
        if a < b:
            dh[a:b] += dw[a:b] @ p["u"][k].T
            # a class's words learn at their own pace: its mean over the batch's rows of the class
            p["u"][k] -= rate / (b - a) ** 0.5 / n**0.5 * (h[a:b].T @ dw[a:b])
            p["ub"][k] -= rate / (b - a) ** 0.5 / n**0.5 * dw[a:b].sum(0)
    da = dh * (1 - h * h)
    dx = (da @ p["w"].T).reshape(-1, EMBED)
    ids = context.ravel()
    by = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[by]) > 0])
    p["c"] -= rate / n * (h.T @ dc)
    p["cb"] -= rate / n * dc.sum(0)
    p["w"] -= rate / n * (x.T @ da)
    p["b"] -= rate / n * da.sum(0)
    sums, count = np.add.reduceat(dx[by], first), np.diff(np.r_[first, len(ids)])
    p["e"][ids[by][first]] -= (rate / n**0.5) * sums / count[:, None] ** 0.5


def _batches(rows, size: int):
    """(rows, padded ids) of whole documents, `size` words or one document at least."""
    gap = np.full(WINDOW, PAD, "<u2")
    held, parts, total = [], [gap], 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        held.append(r)
        parts += [ids, gap]
        total += len(ids)
        if total >= size:
            yield held, np.concatenate(parts)
            held, parts, total = [], [gap], 0
    if held:
        yield held, np.concatenate(parts)


def train_shard(rows, p: dict[str, np.ndarray], rate: float) -> int:
    """Gradient steps over the rows' words, changing p; the number of words."""
    total = 0
    for _, ids in _batches(rows, 1 << 16):
        context, target = windows(ids), ids[WINDOW:-WINDOW]
        real = target != PAD
        context, target = context[real], target[real]
        for at in range(0, len(target), BATCH):
            step(p, context[at : at + BATCH], target[at : at + BATCH], rate)
        total += len(target)
    return total


def train(encoded: DataFrame, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> dict[str, np.ndarray]:
    """Rounds over the parts of the corpus, each from the mean of the last one's shards; the rate falls by rounds."""
    p = start_parameters()
    words = encoded.agg(F.sum("n_words")).first()[0]
    if not words:
        return p
    shards = -(-words // (rounds * shard_words))
    mark = F.xxhash64("doc_id", "ids")
    dealt = encoded.where("n_words > 0").select("doc_id", "ids", F.pmod(mark, F.lit(rounds)).alias("round"), F.pmod(F.floor(mark / rounds), F.lit(shards)).alias("shard"))
    for k in range(rounds):
        p = _round(dealt.where(F.col("round") == k).select("doc_id", "ids", "shard"), p, RATE / (1 + k) ** 0.5, shards) or p
    return p


def _round(dealt: DataFrame, p: dict[str, np.ndarray], rate: float, shards: int) -> dict[str, np.ndarray] | None:
    """The mean of what the shards make of p, weighted by their words."""
    known = dealt.sparkSession.sparkContext.broadcast(flat(p))  # about 1 MB

    def make(rows):
        from itertools import groupby

        for shard, group in groupby(rows, key=lambda r: r["shard"]):
            p = unflat(known.value.copy())
            total = train_shard(group, p, rate)
            x = flat(p)
            for i in range(0, len(x), SLICE):
                yield {"part": shard, "slice": i // SLICE, "words": total, "values": (x[i : i + SLICE].astype(float) * total).astype("<f8").tobytes()}

    tasks = min(2 * shards, 20_000)  # hashed: some get none
    ordered = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", F.xxhash64("ids"), "doc_id", "ids")
    now, top = materialise(map_rows(ordered, make, "part long, slice int, words long, values binary", 64), "trained"), shards - 1

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(v) for v in pdf.sort_values("part")["values"])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "slice": [pdf["slice"].iloc[0]], "words": [pdf["words"].sum()], "values": [total.tobytes()]})

    while True:
        now = now.groupBy(F.floor(F.col("part") / FAN_IN).alias("to"), F.col("slice").alias("of")).applyInPandas(add, "part long, slice int, words long, values binary")
        if top < FAN_IN:
            break
        now, top = materialise(now, "trained"), top // FAN_IN
    rows = sorted(now.collect(), key=lambda r: r["slice"])  # one set of parameters
    return unflat(np.concatenate([np.frombuffer(r["values"]) / r["words"] for r in rows])) if rows else None


def score(encoded: DataFrame, parameters: dict[str, np.ndarray]) -> DataFrame:
    """encode()'s rows to (doc_id, n_words, log_prob, mean_log_prob)."""
    known = encoded.sparkSession.sparkContext.broadcast(parameters)

    def make(rows):
        p, tables = known.value, tables_of(known.value)
        for held, ids in _batches(rows, 1 << 15):
            target = ids[WINDOW:-WINDOW]
            logs = np.zeros(len(target))
            for at in range(0, len(target), BATCH):
                part = target[at : at + BATCH]
                got = log_probabilities(p, tables, windows(ids[at : at + len(part) + 2 * WINDOW]), part)
                logs[at : at + len(part)] = np.where(part == PAD, 0, got)
            sums, at = np.r_[0, np.cumsum(logs)], 0
            for r in held:
                n = r["n_words"]
                total = float(sums[at + n] - sums[at]) + r["dealt"] if n else 0.0
                yield {"doc_id": r["doc_id"], "n_words": n, "log_prob": total, "mean_log_prob": total / n if n else None}
                at += n + WINDOW

    return map_rows(encoded, make, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"))
    return score(encoded, train(encoded))
