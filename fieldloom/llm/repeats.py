"""Substring deduplication by suffix automata: every window of WINDOW words that starts anywhere else goes.

A window's anchor is the run of GRAM words in it with the least hash (the leftmost of equals), which depends on the
window's words alone, so equal windows have equal anchors, at the same place. Consecutive windows with one anchor form
a stretch; each window of a text lies in exactly one. Stretches whose anchor occurs once in the corpus hold no repeat
and are dropped before any words travel.

The others are the reference, in shards by anchor. Equal stretches are one entry with a count. Each shard's suffix
automaton is built over its stretches' words, with the number of places of every substring; the stretches of the
documents are then streamed through it for their matching statistics, the length of the longest suffix at each word
that occurs elsewhere, and windows of WINDOW words or more are repeats. An anchor with one distinct stretch needs no
automaton: all its windows occur as often as it does. An anchor with over MOST distinct stretches is cut further, into
shards of one whole window each, for which counting by key says what an automaton of one window would.

Nothing is broadcast: an automaton of the whole corpus has no bound, and sending all shards' automata to all documents
is work that grows with the square of the corpus. The anchor says which shard a stretch can match, so the stretch
travels there.

Words are compared by their 64-bit hashes, stretches by 128 bits (anchor and polynomial hash).

Defined cases: null texts have no words; texts of fewer than WINDOW words lose none; equal texts are judged once, with
their count; a null or repeated doc_id is a row of its own; an empty table gives an empty result; extra columns are
ignored. One task holds one text at a time with its words, at some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, map_rows, materialise, table

WINDOW = 35
GRAM = 8
#: Distinct stretches of a shard's automaton.
MOST = 128
_CHUNK = 4096
_KEPT_WORDS = 400_000
_P = 0x9E3779B97F4A7C15
_words: dict[bytes, int] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > _KEPT_WORDS:
        _words.clear()
    get, digest = _words.get, xxhash.xxh64_intdigest
    for w in set(words):
        if w not in _words:
            _words[w] = digest(w)
    return np.fromiter(map(get, words), np.uint64, len(words))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Text:
    """Hashes of a text's words, and of any run of them by its first and last word."""

    def __init__(self, words: list[bytes]):
        self.h = hashes(words)
        self.up, down = _powers_upto(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(self.h * down[:-1], out=self.sums[1:], dtype=np.uint64)

    def run_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.up[a]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def stretches(self, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor hash) of each stretch, in order."""
        n = len(self.h) - window + 1
        if n <= 0:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
        at = np.arange(len(self.h) - gram + 1)
        g = self.run_hash(at, at + gram)
        view = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
        place = np.concatenate([view[i : i + _CHUNK].argmin(1) + np.arange(i, min(n, i + _CHUNK)) for i in range(0, n, _CHUNK)])
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return first, np.diff(np.r_[first, n]), g[place[first]]


class Automaton:
    """Suffix automaton of several sequences, with the number of places, by weight, of each state's substrings."""

    def __init__(self):
        self.next, self.link, self.length, self.places = [{}], [-1], [0], [0]

    def _state(self, steps: dict, link: int, length: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of q that follows p: q itself, or a copy for its shorter substrings."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def add(self, sequence: list[int], weight: int = 1) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state({}, 0, self.length[last] + 1), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            self.places[last] += weight

    def settle(self) -> list[int]:
        """Sum up places, and give for each state its longest suffix's state with two places or more."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            self.places[self.link[v]] += self.places[v]
        again = [0] * len(self.link)
        for v in order:
            again[v] = v if self.places[v] > 1 else again[self.link[v]]
        return again

    def statistics(self, sequence: list[int], again: list[int]) -> list[int]:
        """At each word of a sequence that was added, the length of the longest suffix that has two places or more."""
        v, out = 0, []
        for size, c in enumerate(sequence, 1):
            v = self.next[v][c]
            out.append(min(size, self.length[again[v]]))
        return out


def shard_masks(stretches: list[tuple[list[int], int]], window: int = WINDOW) -> list[int]:
    """For each (words, count) of a shard, the windows that occur elsewhere too, as bits by their first word."""
    automaton = Automaton()
    for words, count in stretches:
        automaton.add(words, count)
    again = automaton.settle()
    return [sum(1 << i for i, size in enumerate(automaton.statistics(words, again)[window - 1 :]) if size >= window) for words, _ in stretches]


def removed(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the windows at these starts cover."""
    edge = np.zeros(n_words + window + 1, int)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return edge.cumsum()[:n_words] > 0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _unpacked(r: dict) -> list[bytes]:
    return zstandard.decompress(r["packed"]).split()


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, n_words, kept, anchors) of each row; kept is the digest if no word goes."""

    def make(rows):
        for r in rows:
            raw = (r["text"] or "").encode("utf-8", "surrogatepass")
            words = raw.split()
            _, _, anchors = Text(words).stretches(window) if len(words) >= window else (0, 0, np.zeros(0, np.uint64))
            yield {"doc_id": r["doc_id"], "key": hashlib.sha256(raw).digest()[:16], "n_words": len(words), "kept": _digest(words), "anchors": _signed(anchors).tolist()}

    return map_rows(docs, make, "doc_id long, key binary, n_words long, kept binary, anchors array<long>")


def _candidates(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(n, key, copies, hits, packed) of the distinct texts that hold a repeated anchor: its hash, the anchors, the text."""
    # one row of each text stands for it; where several have its id, they are told apart by merging them below
    each = scanned.where(F.size("anchors") > 0).groupBy("key", "doc_id").agg(F.count("*").alias("rows"), F.first("anchors").alias("anchors"))
    texts = each.groupBy("key").agg(F.min(F.struct("doc_id", "rows")).alias("one"), F.sum("rows").alias("copies"), F.first("anchors").alias("anchors"))
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("n"), "key", "one", "copies", "anchors"), "texts")
    counts = texts.select("copies", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.sum("copies").alias("places"))
    repeated = materialise(counts.where("places > 1").select("anchor"), "anchors")
    own = texts.select("n", F.explode(F.array_distinct("anchors")).alias("anchor"))
    hits = own.join(repeated, "anchor", "left_semi").groupBy("n").agg(F.collect_list("anchor").alias("hits"))  # a text's own
    wanted = materialise(texts.drop("anchors").join(hits, "n"), "wanted")

    def pack(rows):
        for r in rows:
            raw = (r["text"] or "").encode("utf-8", "surrogatepass")
            yield {"id": r["doc_id"], "its": hashlib.sha256(raw).digest()[:16], "packed": zstandard.compress(raw)}

    ours = (F.col("its") == F.col("key")) & F.col("id").eqNullSafe(F.col("one.doc_id"))
    found = map_rows(docs, pack, "id long, its binary, packed binary").join(wanted, ours).select("n", "key", "copies", "hits", "packed", (F.col("one.rows") > 1).alias("several"))
    found = materialise(found, "found")
    merged = found.where("several").groupBy("n").agg(*[F.first(c).alias(c) for c in ("key", "copies", "hits", "packed")])
    return found.where("not several").drop("several").unionByName(merged)


def _stretch_rows(candidates: DataFrame, window: int) -> DataFrame:
    """(anchor, body, n, at, size, copies): each stretch with a repeated anchor, and the hash of its words."""

    def make(rows):
        for r in rows:
            text = Text(_unpacked(r))
            first, size, anchors = text.stretches(window)
            hit = np.isin(_signed(anchors), r["hits"])
            first, size, anchors = first[hit], size[hit], anchors[hit]
            body = text.run_hash(first, first + size + window - 1)
            for a, b, at, k in zip(_signed(anchors).tolist(), _signed(body).tolist(), first.tolist(), size.tolist(), strict=True):
                yield {"anchor": a, "body": b, "n": r["n"], "at": at, "size": k, "copies": r["copies"]}

    return map_rows(candidates, make, "anchor long, body long, n long, at int, size int, copies long", 2048, arrays=("hits",))


def _of_automata(shards: DataFrame, window: int) -> DataFrame:
    """(anchor, body, mask) of shards (anchor, body, places, words): one anchor's rows follow one another, MOST at most."""

    def make(rows):
        for _, group in groupby(rows, key=lambda r: r["anchor"]):
            held = list(group)
            masks = shard_masks([(np.frombuffer(r["words"], np.uint64).tolist(), r["places"]) for r in held], window)
            for r, mask in zip(held, masks, strict=True):
                if mask:
                    yield {"anchor": r["anchor"], "body": r["body"], "mask": mask}

    return map_rows(shards.repartition("anchor").sortWithinPartitions("anchor", "body"), make, "anchor long, body long, mask long")


def _masks(stretches: DataFrame, candidates: DataFrame, window: int, most: int) -> DataFrame:
    """(anchor, body, mask) of the distinct stretches with a repeated window."""
    bodies = stretches.groupBy("anchor", "body").agg(F.sum("copies").alias("places"), F.min(F.struct("n", "at", "size")).alias("one"))
    bodies = materialise(bodies, "bodies")
    anchors = bodies.groupBy("anchor").agg(F.count("*").alias("bodies"))
    sorts = materialise(bodies.join(anchors, "anchor"), "sorts")
    alone = sorts.where("bodies = 1 and places > 1").select("anchor", "body", F.expr("shiftleft(1L, one.size) - 1").alias("mask"))

    wanted = sorts.where("bodies > 1").select("one.n", F.struct("anchor", "body", "places", "one.at", "one.size", (F.col("bodies") > most).alias("cut")).alias("row"))
    wanted = wanted.groupBy("n").agg(F.collect_list("row").alias("rows"))  # a text's own

    def words(rows):
        for r in rows:
            text = Text(_unpacked(r))
            for x in r["rows"]:
                at, end = x["at"], x["at"] + x["size"]
                own = {"anchor": x["anchor"], "body": x["body"], "places": x["places"]}
                if x["cut"]:
                    spots = np.arange(at, end)
                    for i, w in enumerate(_signed(text.run_hash(spots, spots + window)).tolist()):
                        yield own | {"bit": i, "window": w, "words": None}
                else:
                    yield own | {"bit": None, "window": None, "words": text.h[at : end + window - 1].tobytes()}

    shards = map_rows(candidates.select("n", "packed").join(wanted, "n"), words, "anchor long, body long, places long, bit int, window long, words binary", 1024)
    shards = materialise(shards, "shards")
    compared = _of_automata(shards.where("words is not null").select("anchor", "body", "places", "words"), window)
    single = shards.where("words is null")
    common = single.groupBy("anchor", "window").agg(F.sum("places").alias("places")).where("places > 1").select("anchor", "window")
    cut = single.join(common, ["anchor", "window"], "left_semi").groupBy("anchor", "body").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return alone.unionByName(compared).unionByName(cut)


def _judged(docs: DataFrame, window: int, most: int, texts: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words, kept) of each row, and (key, n_removed, rest, text) of the texts that lose words."""
    if not GRAM <= window <= GRAM + 61:
        raise ValueError(f"a window has {GRAM} to {GRAM + 61} words")
    scanned = materialise(_scan(docs, window), "scanned")
    candidates = materialise(_candidates(docs, scanned), "candidates")
    stretches = materialise(_stretch_rows(candidates.select("n", "copies", "hits", "packed"), window), "stretches")
    masks = materialise(_masks(stretches, candidates, window, most), "masks")
    spots = stretches.join(masks, ["anchor", "body"]).groupBy("n").agg(F.collect_list("at").alias("ats"), F.collect_list("mask").alias("bits"))  # a text's own

    def cut(rows):
        for r in rows:
            words = _unpacked(r)
            which, bit = np.nonzero((r["bits"][:, None] >> np.arange(window - GRAM + 1)) & 1)
            gone = removed(len(words), r["ats"][which] + bit, window)
            left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            yield {"key": r["key"], "n_removed": int(gone.sum()), "rest": _digest(left), "left": b" ".join(left).decode("utf-8", "surrogatepass") if texts else None}

    done = map_rows(candidates.select("n", "key", "packed").join(spots, "n"), cut, "key binary, n_removed long, rest binary, left string", arrays=("ats", "bits"))
    done = materialise(done, "removed")
    for t in (candidates, stretches, masks):
        discard(t)
    return scanned.drop("anchors"), done


def without_repeats(docs: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_removed, kept_sha256)."""
    rows, done = _judged(docs.select(F.col("doc_id").cast("long"), "text"), window, most, False)
    return rows.join(done, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("rest", "kept"))).alias("kept_sha256")
    )


def kept_texts(docs: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """(doc_id, text) to (doc_id, text): the words that are left, joined by spaces."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    _, done = _judged(docs, window, most, True)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"))
    return keyed.join(done, "key", "left").select("doc_id", F.coalesce("left", F.array_join(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), " ")).alias("text"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the windows of 35 words that occur elsewhere."""
    return without_repeats(table(spark, sf_dir, "documents"))
