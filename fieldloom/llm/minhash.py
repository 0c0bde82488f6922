"""Document fingerprints: MinHash signatures over 5-word shingles, in vectorised numpy.

A shingle's hash combines the hashes of its words (XXH64 of the ASCII-lower-cased bytes); PERMUTATIONS
multiply-shift universal hashes of it are minimised over a text, and 8 bits of each minimum kept (b-bit
minwise hashing). The share of equal positions of two fingerprints, less what chance adds, estimates the
Jaccard similarity of the shingle sets.

near_groups() joins bands of the signatures in Spark and verifies candidates by the Jaccard similarity
itself, of texts whose fingerprints come near enough: within a bucket first with its representative, so a
group of near copies is not compared pair by pair; then, exactly, what no link has brought together yet,
in blocks of at most 2 * CHUNK texts, so a bucket of any size is many small pieces of work. A pair that
shares several buckets is compared in the first.

Texts cross the network compressed, each by itself.

Defined cases: null counts as empty; a text without words has the all-ones fingerprint; fewer than 5
words are one shingle; rows with equal doc_id are ordered by text hash, null ids come first; the row
after the last is the first, which may be the row itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, map_rows, materialise, table

SHINGLE = 5
PERMUTATIONS = 128
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Pairs whose fingerprints agree in a smaller share are not verified: 4 standard deviations below SIMILARITY.
LEAST = 0.65
#: Texts of a bucket that a block of the exact pass takes from either side.
CHUNK = 256
#: Representatives that a bucket's members are linked with, one after another, before the exact pass.
_ROUNDS = 2
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_EMPTY = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
_P = np.uint64(0x9E3779B97F4A7C15)
_STEP = 512
_words: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the 5-word shingles in order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > 400_000:
        _words.clear()
    get, digest = _words.get, xxhash.xxh64_intdigest
    for w in {w for w in words if w not in _words}:
        _words[w] = digest(w)
    h = np.array([get(w) for w in words], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(h), SHINGLE)))
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * _P
        out ^= out >> np.uint64(29)
    return out


def minima(x: np.ndarray) -> np.ndarray:
    best = _EMPTY
    for at in range(0, len(x), _STEP):
        best = np.minimum(best, (x[at : at + _STEP, None] * _A + _B).min(0))
    return best


def _bits(best: np.ndarray) -> np.ndarray:
    """8 bits of each minimum; not the highest, which say how many shingles there are."""
    return (best >> np.uint64(24)).astype(np.uint8)


def signature(text: str | None) -> np.ndarray:
    return _bits(minima(shingles(words_of(text or ""))))


def edited(text: str, after: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def signatures(text: str, after: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of text and of its edited text; shingles that both have are hashed and minimised once."""
    words = words_of(text)
    x = shingles(words)
    if after is None:
        return _bits(minima(x)), None
    new = words_of(edited(text, after))
    same = next((i for i, (a, b) in enumerate(zip(words, new)) if a != b), min(len(words), len(new)))
    shared = max(0, same - SHINGLE + 1)
    if not shared:
        return _bits(minima(x)), _bits(minima(shingles(new)))
    head = minima(x[:shared])
    own = np.minimum(head, minima(x[shared:]))
    other = np.minimum(head, minima(shingles(new[shared:]))) if len(new) - shared >= SHINGLE else head
    return _bits(own), _bits(other)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: 1 if all positions agree, 0 if no more do than by chance."""
    chance = 1 / 256
    return max(0.0, float(((a == b).mean() - chance) / (1 - chance)))


def _row(doc_id, text: str, after: str, after_signature: np.ndarray | None = None) -> dict:
    own, other = signatures(text, after)
    following = signature(after) if after_signature is None else after_signature
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited(text, after).encode("utf-8", "surrogatepass")).digest(),
        "text_key": hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16], "fingerprint": own.tobytes(), "edited_fingerprint": other.tobytes(), "near_edited": likeness(own, other), "near_next": likeness(own, following),
    }


_RESULT = "doc_id long, n_chars long, text_key binary, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_BLANK = dict.fromkeys(("n_chars", "text_key", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))


def _pack(text: str | None) -> bytes:
    return zstandard.compress((text or "").encode("utf-8", "surrogatepass"))


def _unpack(packed: bytes) -> str:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass")


def _packed(rows):
    for r in rows:
        text = r.pop("text")
        yield r | {"packed": _pack(text)}


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row a document: its fingerprint, its edited text's, and their likenesses.

    One range shuffle puts documents next to their followers. A partition's last document waits for the
    first of the next: these two texts of each partition are written out and joined afterwards.
    """

    def make(rows):
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        for r in rows:
            text = _unpack(r["packed"])
            if last is not None:
                yield from _finish(last, text)
            else:
                first = text
            last = (r["doc_id"], text)
        if last is not None:
            yield {"doc_id": last[0], **_BLANK, "part": part, "first": first, "last": last[1]}

    def _finish(row, after):
        yield {**_row(*row, after), "part": None, "first": None, "last": None}

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    order = ["doc_id", "tie"]
    dealt = map_rows(keyed, _packed, "doc_id long, tie long, packed binary").repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialise(map_rows(dealt, make, f"{_RESULT}, part int, first string, last string", 64), "fingerprints")
    ends = done.where("part is not null").select("doc_id", "part", "first", "last")
    everything = W.partitionBy()
    follow = ends.select("part").withColumn("follower", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(everything)))  # a row a partition
    joined = ends.select("doc_id", "part", "last").join(follow, "part").join(ends.select(F.col("part").alias("follower"), F.col("first").alias("after")), "follower")

    def finish(rows):
        for r in rows:
            yield _row(r["doc_id"], r["last"], r["after"])

    names = [c.split()[0] for c in _RESULT.split(", ")]
    # written, too: what comes of it is read several times
    rest = materialise(map_rows(joined, finish, _RESULT, 64), "fingerprints")
    return done.where("part is null").select(*names).unionByName(rest.select(*names))


def _links(blocks: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) of blocks (block, a array, b array) whose Jaccard similarity is SIMILARITY or more.

    packed has the text of each node; a block's texts are brought together once, whatever its pairs.
    """
    nodes = blocks.select("block", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).join(packed, "node")
    rows = nodes.select("block", "node", "packed", *[F.lit(None).cast("array<long>").alias(c) for c in "ab"]).unionByName(blocks, allowMissingColumns=True)

    def make(rows):
        sets: dict[int, np.ndarray] = {}
        for r in rows:
            if r["node"] is not None:
                sets[r["node"]] = np.unique(shingles(words_of(_unpack(r["packed"]))))
                continue
            for a, b in zip(r["a"], r["b"], strict=True):
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common / (len(x) + len(y) - common) >= SIMILARITY:
                    yield {"a": a, "b": b}
            sets.clear()

    ordered = rows.repartition("block").sortWithinPartitions("block", F.col("node").asc_nulls_last())
    return materialise(map_rows(ordered, make, "a long, b long", 64), "links")


_BLOCK = "block long, a array<long>, b array<long>"


def _star_blocks(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Blocks of the pairs (a, b) with likely fingerprints, those of one b together, CHUNK at most."""
    both = pairs.join(prints.withColumnRenamed("node", "a"), "a").join(prints.select(F.col("node").alias("b"), F.col("fingerprint").alias("other")), "b")

    def make(rows):
        from pyspark import TaskContext

        n, held, at = TaskContext.get().partitionId() << 33, [], None
        for r in rows:
            if held and (r["b"] != at or len(held) == CHUNK):
                yield {"block": n, "a": held, "b": [at] * len(held)}
                n, held = n + 1, []
            at = r["b"]
            if likeness(np.frombuffer(r["fingerprint"], np.uint8), np.frombuffer(r["other"], np.uint8)) >= LEAST:
                held.append(r["a"])
        if held:
            yield {"block": n, "a": held, "b": [at] * len(held)}

    dealt = both.repartition("b", F.pmod(F.xxhash64("a"), F.lit(64))).sortWithinPartitions("b", "a")
    return materialise(map_rows(dealt, make, _BLOCK), "blocks")


def _apart_blocks(labelled: DataFrame, prints: DataFrame, chunk: int) -> DataFrame:
    """Blocks of the likely pairs of a bucket that have different labels, each pair in its first common bucket.

    labelled: (bucket, band, node, label). Most of a bucket has its lowest label: those texts, in chunks, meet the chunks
    of all others, but not each other.
    """
    low = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    rows = labelled.join(low.where("low <> high").select("bucket", "low"), "bucket").withColumn("own", F.col("label") == F.col("low"))
    sizes = rows.groupBy("bucket").agg(F.ceil(F.sum(F.when(F.col("own"), 1)) / chunk).alias("owns"), F.ceil(F.sum(F.when(~F.col("own"), 1)) / chunk).alias("others"))
    rows = rows.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("owns")).otherwise(F.col("others"))))
    i, j = F.lit(0).cast("long"), F.col("others")
    with_own = F.transform(F.sequence(i, F.col("others") - 1), lambda x: F.struct(x.alias("i"), (j + F.col("part")).alias("j")))
    after = F.transform(F.sequence(F.col("part"), F.col("others") - 1), lambda x: F.struct(F.col("part").alias("i"), x.alias("j")))
    before = F.transform(F.sequence(i, F.col("part")), lambda x: F.struct(x.alias("i"), F.col("part").alias("j")))
    to_own = F.transform(F.sequence(i, F.col("owns") - 1), lambda x: F.struct(F.col("part").alias("i"), (j + x).alias("j")))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("own"), with_own).otherwise(F.array_distinct(F.concat(before, after, to_own)))))
    rows = rows.withColumn("place", F.when(F.col("own"), j + F.col("part")).otherwise(F.col("part")))
    rows = rows.select("bucket", "band", "pair.i", "pair.j", "place", "node", "label").join(prints, "node")

    def make(rows):
        from itertools import groupby

        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33
        for (_, i, j), group in groupby(rows, key=lambda r: (r["bucket"], r["i"], r["j"])):
            held = list(group)
            node, label, place = (np.array([r[k] for r in held]) for k in ("node", "label", "place"))
            prints = np.frombuffer(b"".join(r["fingerprint"] for r in held), np.uint8).reshape(len(held), -1)
            x, y = np.flatnonzero(place == i), np.flatnonzero(place == j)
            a, b = [], []
            for k in x:
                rest = y[y > k] if i == j else y
                rest = rest[label[rest] != label[k]]
                same = prints[rest] == prints[k]
                likely = same.mean(1) >= LEAST
                rest, bands = rest[likely], same[likely, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2)
                rest = rest[bands.argmax(1) == held[0]["band"]]
                a += [node[k]] * len(rest)
                b += node[rest].tolist()
            if a:
                yield {"block": n, "a": a, "b": b}
                n += 1

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return materialise(map_rows(dealt, make, _BLOCK, 16), "blocks")


def near_groups(prints: DataFrame, docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(text_key, component_id, group_size) of the texts of docs that are not alone, of which prints has doc_id, text_key and fingerprint.

    A group is what links of SIMILARITY or more connect; copies of a text are of its group, and texts without words
    are of no other's. component_id is its smallest id, null if it has none; group_size counts its rows.
    """
    one = prints.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("fingerprint").alias("fingerprint"))
    texts = materialise(one.withColumn("node", F.monotonically_increasing_id()), "texts")
    values = F.array(*[F.xxhash64(F.lit(i), F.substring("fingerprint", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    bands = texts.where(F.col("fingerprint") != F.unhex(F.lit("FF" * PERMUTATIONS))).select("node", F.posexplode(values).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = materialise(bands.join(shared, "bucket"), "buckets")
    wanted = materialise(texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_key", "doc_id", "fingerprint"), "wanted")
    marks = wanted.select("node", "fingerprint")
    key = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
    # one row of each text, or equal ones: copies have other ids
    ours = (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id").cast("long"))
    found = docs.select(key.alias("key"), "doc_id", "text").join(wanted.select("node", "text_key", F.col("doc_id").alias("id")), ours).select("node", "text")
    packed = materialise(map_rows(found, _packed, "node long, packed binary"), "packed")
    rest, links = members, None
    for _ in range(_ROUNDS):
        reps = rest.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
        pairs = rest.withColumnRenamed("node", "a").join(reps, "bucket").where("a <> b")
        new = _links(_star_blocks(pairs.select("a", "b").distinct(), marks), packed)
        links = new if links is None else links.unionByName(new)
        rest = materialise(pairs.join(new, ["a", "b"], "left_anti").select(F.col("a").alias("node"), "band", "bucket"), "rest")
        if rest.isEmpty():
            break
    named = materialise(components(links), "components")
    labelled = members.join(named.withColumnRenamed("id", "node"), "node", "left").select("node", "band", "bucket", F.coalesce("component_id", "node").alias("label"))
    more = _links(_apart_blocks(materialise(labelled, "labelled"), marks, chunk), packed)
    if not more.isEmpty():
        named = materialise(components(links.unionByName(more)), "components")
    linked = texts.join(named.withColumnRenamed("id", "node"), "node").select("text_key", "doc_id", "n", F.col("component_id").alias("label"))
    copies = texts.where("n > 1").join(named.select(F.col("id").alias("node")), "node", "left_anti").select("text_key", "doc_id", "n", F.col("node").alias("label"))
    nodes = materialise(linked.unionByName(copies), "nodes")
    groups = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("group_size"))
    return nodes.join(groups, "label").select("text_key", "component_id", "group_size")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = with_next(docs)
    grouped = materialise(near_groups(prints, docs), "groups").withColumn("grouped", F.lit(True))
    out = prints.join(grouped, "text_key", "left").drop("text_key")
    alone = F.col("grouped").isNull()
    out = out.withColumns({"component_id": F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")})
    return out.drop("grouped").withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
