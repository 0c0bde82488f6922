"""Alignment of two tokenizers over documents, each distinct segment once.

A text, with a space before it, is cut before white-space runs. A run may begin a segment if its first character follows
anything but white space in no token of either vocabulary, which is read off the vocabularies: then no merge of either
crosses the cut, and the byte-level side's own splitting, whose parts never go on into white space, starts anew there.
Runs that begin with any other white space stay inside a segment.

Segments are counted over the corpus, tokenized and aligned once each: both sides' tokens as byte ranges, groups between
offsets where both end, links between tokens whose ranges overlap. Segments times counts give the counts of linked id
pairs, and those the scores of each segment. Then alignments are joined back and documents composed, in order, from the
groups and sums of their segments. The BROADCAST most frequent segments, a fixed number, go to every task. The others
are asked for once by each block of documents, joined by segment, and come back to the block packed.

Pair counts go to every task if there are PAIRS of them at most (two vocabularies have far fewer pairs that overlap than
they have pairs); else they are joined.

Defined cases: null and empty texts, and texts whose joined tokens differ from them on either side (those with a
character that the piece model's normaliser changes, or U+2581, which comes back as a space), have no tokens; a null or
repeated doc_id is a row of its own; an empty table gives an empty result; extra columns are ignored. One task holds a
text at a time with its segments, at some 100 bytes a segment, and a block's alignments.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections import Counter, defaultdict
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SPACE = "▁"
#: So many of the most frequent segments are broadcast with their alignments, some 30 MB.
BROADCAST = 200_000
PAIRS = 2_000_000
#: Characters of the texts that ask for segments together, at most; a partition's, if it has fewer.
BLOCK = 1 << 25
_HELD = 400_000
_BATCH = 4096


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers: A byte-level, B of pieces that puts a space before a text."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel work
        import sentencepiece
        from tokenizers import Tokenizer

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
            path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_of = byte_table()
        self.raw_a = {i: bytes(bytes_of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in bytes_of for c in t)}
        self.raw_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.raw_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.size_a, self.size_b = np.zeros(max(self.raw_a) + 1, np.int64), np.array(list(map(len, self.raw_b)), np.int64)
        self.size_a[list(self.raw_a)] = list(map(len, self.raw_a.values()))
        texts = [r.decode("utf-8", "replace") for r in chain(self.raw_a.values(), self.raw_b)]
        inside = {c for t in texts for before, c in zip(t, t[1:]) if not before.isspace()}
        #: White space that no token has after anything else.
        self.splits = "".join(c for c in " \t\n\v\f\r" if c not in inside)
        if " " not in self.splits or any("\n" in self.b.id_to_piece(i) for i in range(self.b.vocab_size())):
            raise ValueError("tokens of these vocabularies go on over spaces or line ends")
        held = f"[^\\S{re.escape(self.splits)}]"
        self.segments = re.compile(rf"\s+\S*(?:{held}\s*\S*)*").findall
        self.odd = re.compile(f"[{re.escape(''.join(self._changed()))}]").search

    def _changed(self) -> list[str]:
        """Characters that B does not give back."""
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i) != SPACE)
        if self.b.normalize(every) == SPACE + every.replace(" ", SPACE):
            return [SPACE]
        return [SPACE, *[c for c in every if self.b.normalize("x" + c + "x") != f"{SPACE}x{c}x".replace(" ", SPACE)]]

    def cut(self, text: str | None) -> list[str] | None:
        """Segments of a text with a space before it; None if it has no tokens."""
        return None if not text or self.odd(text) else self.segments(" " + text)

    def ids(self, run: str) -> tuple[list[int], list[int]]:
        """A's and B's ids of a text that begins with a space or another character that splits."""
        # the space that B adds is the text's own, if it has one; else a line end, which merges with nothing, parts them
        own = run[0] == " " and len(run) > 1
        b = self.b.encode(run[1:] if own else "\n" + run, num_threads=1)
        return self.a.encode(run, add_special_tokens=False).ids, b if own else b[2:]

    def align(self, segments: list[str]) -> list[Aligned]:
        """Each segment's alignment. Segments that end in no white space follow one another as in a text, so they are tokenized as one."""
        out, run = [], []
        for s in segments:
            if s[-1].isspace():
                out += self._aligned(run) + self._aligned([s])
                run = []
            else:
                run.append(s)
        return out + self._aligned(run)

    def _aligned(self, segments: list[str]) -> list[Aligned]:
        if not segments:
            return []
        raw = [s.encode() for s in segments]
        a, b = map(np.array, self.ids("".join(segments)))
        if b"".join(map(self.raw_a.__getitem__, a.tolist())) != b"".join(raw) or b"".join(map(self.raw_b.__getitem__, b.tolist())) != b"".join(raw):
            raise ValueError(f"tokens of one of {segments[:3]!r}... do not give it back, though its characters do")
        ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        stops = np.fromiter(map(len, raw), np.int64, len(raw)).cumsum()
        # between two ends of either side lies one token of each, which is a link
        ends, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = (b[np.searchsorted(ends_b, ends)] << 32 | a[np.searchsorted(ends_a, ends)]).tolist()
        upto = [np.searchsorted(x, stops, "right").tolist() for x in (common, ends_a, ends_b, ends)]
        if len(np.setdiff1d(stops, common)):
            raise ValueError(f"a token crosses the end of one of {segments[:3]!r}...")
        to_a, to_b = (np.searchsorted(x, common, "right").tolist() for x in (ends_a, ends_b))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:n])}" for i, j, k, n in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        return [Aligned(";".join(groups[g:h]), j - i, n - k, h - g, links[x:y]) for (g, h), (i, j), (k, n), (x, y) in zip(*(pairwise([0, *u]) for u in upto))]


class Aligned(NamedTuple):
    """Groups as text, numbers of A's ids, B's ids and groups, and links as b << 32 | a."""

    groups: str
    n_a: int
    n_b: int
    n_groups: int
    links: list[int]


_PAIRS: dict[tuple, Pair] = {}


def pair(paths: tuple) -> Pair:
    """One a worker process."""
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


def _counts(docs: DataFrame, paths: tuple) -> DataFrame:
    """(segment, places) of all texts that have tokens."""
    import pyarrow as pa

    schema = pa.schema([("segment", pa.string()), ("places", pa.int64())])

    def flush(held):
        names = sorted(held)  # neighbours alike: they travel smaller
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[s] for s in part], pa.int64())], schema=schema)

    def make(batches):
        p, held = pair(paths), Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(p.cut(text.as_py()) or ())
                if len(held) > _HELD:
                    yield from flush(held)
                    held.clear()
        yield from flush(held)

    return docs.select("text").mapInArrow(make, "segment string, places long").groupBy("segment").agg(F.sum("places").alias("places"))


def _aligned(counts: DataFrame, paths: tuple) -> DataFrame:
    """(segment, places, groups, n_a, n_b, n_groups, links) of each segment, tokenized here and nowhere else."""
    import pyarrow as pa

    fields = [("segment", pa.string()), ("places", pa.int64()), ("groups", pa.string()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("n_groups", pa.int32()), ("links", pa.list_(pa.int64()))]

    def make(batches):
        p = pair(paths)
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                groups, n_a, n_b, n_groups, links = zip(*p.align(part.column("segment").to_pylist()))
                made = [pa.array(x, t) for x, (_, t) in zip((groups, n_a, n_b, n_groups, links), fields[2:])]
                yield pa.RecordBatch.from_arrays([part.column("segment"), part.column("places"), *made], schema=pa.schema(fields))

    return counts.mapInArrow(make, "segment string, places long, groups string, n_a int, n_b int, n_groups int, links array<long>")


_SCORED = "segment string, places long, groups string, n_a int, n_b int, n_groups int, n_links int, n_best int, count_sum long"


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, count): in how many links of the corpus each pair of ids, b << 32 | a, is linked."""
    return aligned.select("places", F.explode("links").alias("link")).groupBy("link").agg(F.sum("places").alias("count"))


def _scored(aligned: DataFrame, most_pairs: int) -> DataFrame:
    """Adds to each segment how many links it has, how many are their B id's most frequent ones, and the sum of counts."""
    counts = materialise(pair_counts(aligned), "pair-counts")
    if counts.count() > most_pairs:
        best = counts.groupBy(F.shiftright("link", 32).alias("b")).agg(F.max("count").alias("top"))
        marked = counts.withColumn("b", F.shiftright("link", 32)).join(best, "b").select("link", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
        sums = aligned.select("segment", F.explode("links").alias("link")).join(marked, "link").groupBy("segment").agg(F.sum("best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        return materialise(aligned.withColumn("n_links", F.size("links")).join(sums, "segment").select(*[c.split()[0] for c in _SCORED.split(", ")]), "scored")

    import pyarrow as pa

    found = counts.toArrow()
    link, count = found["link"].to_numpy(), found["count"].to_numpy()
    order = np.argsort(link)
    link, count = link[order], count[order]
    b = link >> 32
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    top = np.repeat(np.maximum.reduceat(count, first), np.diff(np.r_[first, len(b)])) if len(b) else count
    sent = aligned.sparkSession.sparkContext.broadcast((link, count, count == top))

    def make(batches):
        link, count, best = sent.value
        for batch in batches:
            links = batch.column("links")
            at = links.offsets.to_numpy()
            spot = np.searchsorted(link, links.values.to_numpy())
            sums = [np.r_[0, np.cumsum(x[spot])] for x in (best, count)]
            n_best, total = ((s[at[1:]] - s[at[:-1]]) for s in sums)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at), pa.int32()), pa.array(n_best, pa.int32()), pa.array(total, pa.int64())], names=[c.split()[0] for c in _SCORED.split(", ")])

    return aligned.mapInArrow(make, _SCORED)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ROW = "block long, kind int, doc_id long, packed binary"


class _Dictionary:
    """Alignments by segment: a row number each, groups by row, numbers by row."""

    def __init__(self, batches: list):
        self.index, self.groups, self.numbers = {}, [], [np.zeros((0, len(_NUMBERS)), np.int64)]
        for b in batches:
            self.add(b)

    def add(self, batch) -> None:
        self.index.update(zip(batch.column("segment").to_pylist(), range(len(self.groups), len(self.groups) + batch.num_rows)))
        self.groups += batch.column("groups").to_pylist()
        self.numbers.append(np.stack([batch.column(c).to_numpy() for c in _NUMBERS], 1).astype(np.int64))

    def copy(self) -> _Dictionary:
        out = _Dictionary([])
        out.index, out.groups, out.numbers = dict(self.index), list(self.groups), list(self.numbers)
        return out

    def table(self) -> np.ndarray:
        if len(self.numbers) > 1:
            self.numbers = [np.concatenate(self.numbers)]
        return self.numbers[0]


def _packed(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(raw).read_next_batch()


_HOT: dict[str, _Dictionary] = {}


def _hot(sent) -> _Dictionary:
    """One a worker process."""
    if sent.value[0] not in _HOT:
        _HOT.clear()
        _HOT[sent.value[0]] = _Dictionary([_unpacked(x) for x in sent.value[1]])
    return _HOT[sent.value[0]]


def _parts(docs: DataFrame, block: int) -> int:
    """Into how many blocks each partition's texts are dealt, so that the largest partition's have `block` characters or so."""
    sizes = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.length("text")).alias("size"))
    return max(1, -(-(sizes.agg(F.max("size")).first()[0] or 0) // block))


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.spark_partition_id().alias("part"))


def _blocks(batches, parts: int):
    """(block, doc_id, text) of a partition's rows. A row's block depends on its partition and text, so two readings of a table in one query agree."""
    for batch in batches:
        for doc_id, text, part in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("part").to_pylist(), strict=True):
            text = text.as_py()
            yield (part << 24) + (zlib.crc32(text.encode()) % parts if text else 0), doc_id, text


def _asked(docs: DataFrame, sent, paths: tuple, parts: int) -> DataFrame:
    """(block, segment) of the segments that were not broadcast."""
    import pyarrow as pa

    def rows(held):
        for number, names in held.items():
            names = sorted(names)
            for at in range(0, len(names), 20_000):
                some = names[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.string())], names=["block", "segment"])

    def make(batches):
        p, known, held, size = pair(paths), _hot(sent).index, defaultdict(set), 0
        for number, _, text in _blocks(batches, parts):
            new = {s for s in set(p.cut(text) or ()) if s not in known}
            size -= len(held[number])
            held[number] |= new
            size += len(held[number])
            if size > 2 * _HELD:
                yield from rows(held)
                held, size = defaultdict(set), 0
        yield from rows(held)

    return _placed(docs).mapInArrow(make, "block long, segment string")


def _answers(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows of kind 0: a block's alignments, those that come from one task packed together."""
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def make(batches):
        for batch in batches:
            number, rest = batch.column("block").to_numpy(), batch.drop_columns(["block"])
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
            for i, j in zip(first, [*first[1:], len(number)]):
                yield pa.RecordBatch.from_pydict({"block": [int(number[i])], "kind": [0], "doc_id": [None], "packed": [_packed(rest.slice(i, j - i))]}, schema=schema)

    joined = asked.join(scored, "segment").select("block", "segment", "groups", *_NUMBERS)
    return joined.sortWithinPartitions("block").mapInArrow(make, _ROW)


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of kind 1: a document each."""
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def make(batches):
        for number, doc_id, text in _blocks(batches, parts):
            packed = None if text is None else zstandard.compress(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([1], pa.int32()), pa.array([doc_id], pa.int64()), pa.array([packed], pa.binary())], schema=schema)

    return _placed(docs).mapInArrow(make, _ROW)


def compose(docs: DataFrame, scored: DataFrame, paths: tuple = (None, None), broadcast: int = BROADCAST, block: int = BLOCK, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text); with `groups`, their text too.

    scored has each segment's alignment and scores. docs is read twice and must come in the same partitions, as a table of
    files does: else a block lacks segments and the run ends with an error.
    """
    import pyarrow as pa

    top = scored.orderBy(F.desc("places"), "segment").limit(broadcast).select("segment", "groups", *_NUMBERS).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [_packed(b) for b in top.to_batches(max_chunksize=50_000)]))
    parts = _parts(docs, block)
    dealt = _answers(_asked(docs, sent, paths, parts), scored).unionByName(_texts(docs, parts))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "kind")
    names = ["doc_id", *_NUMBERS, "groups_sha256", *["groups"] * groups]
    schema = pa.schema([(c, pa.string() if c.startswith("groups") else pa.int64()) for c in names])

    def rows(batches):
        p, hot, at, known = pair(paths), _hot(sent), None, None
        for batch in batches:
            for number, kind, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    at, known = number, hot
                if kind == 0:
                    known = known.copy() if known is hot else known
                    known.add(_unpacked(packed))
                    continue
                segments = p.cut(packed and zstandard.decompress(packed).decode())
                if segments is None:
                    yield (doc_id, *[0] * len(_NUMBERS), "", "")
                    continue
                spots = list(map(known.index.__getitem__, segments))
                text = ";".join(map(known.groups.__getitem__, spots))
                yield (doc_id, *known.table()[spots].sum(0).tolist(), hashlib.sha256(text.encode()).hexdigest(), text)

    def make(batches):
        held = []
        for row in rows(batches):
            held.append(row[: len(names)])
            if len(held) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return dealt.mapInArrow(make, ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in names))


def align_documents(docs: DataFrame, paths: tuple = (None, None), broadcast: int = BROADCAST, block: int = BLOCK, most_pairs: int = PAIRS, groups: bool = False) -> DataFrame:
    """(doc_id, text) to each document's alignment; paths are the two vocabularies' files."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    aligned = materialise(_aligned(_counts(docs, paths), paths), "aligned")
    return compose(docs, _scored(aligned, most_pairs), paths, broadcast, block, groups)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over every document."""
    return align_documents(table(spark, sf_dir, "documents"))
