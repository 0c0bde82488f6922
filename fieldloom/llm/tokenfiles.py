"""Token ids in binary files: one zstandard frame a document, a trailing seek table, a checksum a frame.

A file is a sequence of independent zstandard frames, each the ids of one document as little-endian
unsigned 32-bit integers; a skippable frame with the documents' ids (64-bit, and a byte that is 0 for a
null id); and last a skippable frame with the seek table of the public seekable format: for each frame
its compressed size, its size and the low 32 bits of the XXH64 of its content. A reader that wants some
documents reads the end of the file and their frames, nothing else; a plain zstandard reader gets all
ids in order.

Documents are range-partitioned by doc_id, one file a partition, written by the task under a name of
its own. Only files named in the manifest, which Spark commits with the tasks that succeeded, count: a
task that is lost or run twice leaves a stray file, never a wrong one. The manifest says where every
SPAN-th frame and its ids begin, so a task that reads a span of frames reads only their part of the
tables. Folders are URIs that pyarrow's file systems know (file, hdfs, viewfs, s3, gs, abfs); s3a and
abfss stand for s3 and abfs.

Words between ASCII white space are encoded one by one by the tokenizers library and kept by word, in
ASCII lower case as the vocabulary's own normaliser has it; it never joins across white space, nor
across the border between an ASCII letter or digit and punctuation other than an apostrophe, so the ids
are those of whole texts. Words with "<|", where special tokens can begin, are kept as they stand.

Defined cases: null and empty texts hold the end id alone; a null doc_id comes first; rows with equal
doc_id are ordered by text hash; an empty table writes no file and gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from itertools import chain, filterfalse, islice, pairwise

import numpy as np
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, materialise, scratch_path, table

END_ID = 1
_END = struct.pack("<I", END_ID)
SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Frames that one reading task takes at a time.
SPAN = 8192
MOST_TASKS = 20_000
_KEPT_WORDS = 1_200_000
#: Documents that are encoded at a time.
_TOGETHER = 512
#: Punctuation, a core between ASCII letters or digits, punctuation.
_PEEL = re.compile(rb"([!-&(-/:-@\[-`{-~]*)([a-z0-9](?:.*[a-z0-9])?)([!-&(-/:-@\[-`{-~]*)", re.DOTALL).fullmatch


class _Words(dict):
    """Ids, as little-endian 32-bit numbers, by word (bytes)."""

    def __init__(self, path: str | None):
        super().__init__()
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self[b""] = b""

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that aren't known; of those, the parts that aren't known in one call of the library."""
        if len(self) > _KEPT_WORDS:
            self.clear()
            self[b""] = b""
        new = list(filterfalse(self.__contains__, words))
        parts, split = dict.fromkeys(w for w in new if w.isalnum()), {}
        for w in new:
            if w in parts:
                continue
            cut = None if b"<|" in w else _PEEL(w)
            if cut and (cut[1] or cut[3]):
                split[w] = own = cut.groups()
                for x in own:
                    if x not in self:
                        parts[x] = None
            else:
                parts[w] = None
        if parts:
            names = b" ".join(parts).decode("utf-8", "surrogatepass").split(" ")
            got = self.tokenizer.encode(names, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            at = (np.searchsorted(np.array(got.word_ids, dtype=int), np.arange(len(parts) + 1)) * 4).tolist()
            self.update(zip(parts, (ids[a:b] for a, b in pairwise(at))))
        for w, own in split.items():
            self[w] = b"".join(map(self.__getitem__, own))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text (its UTF-8), with the end id."""
        split = []
        for t in texts:
            raw = t or b""
            split.append([w if b"<|" in w else w.lower() for w in raw.split()] if b"<|" in raw else raw.lower().split())
        self.learn(set(chain.from_iterable(split)))
        return [b"".join(map(self.__getitem__, words)) + _END for words in split]


_WORDS: dict[str | None, _Words] = {}


def words_of(path: str | None) -> _Words:
    """One a worker process, whichever tasks it runs."""
    if path not in _WORDS:
        _WORDS[path] = _Words(path)
    return _WORDS[path]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest)


class FrameWriter:
    def __init__(self, sink):
        self.sink, self.sizes, self.docs = sink, array("I"), bytearray()
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.packer.compress(content)
        self.sink.write(frame)
        self.sizes.extend((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.docs += struct.pack("<qB", doc_id or 0, doc_id is not None)

    def close(self) -> None:
        n = len(self.sizes) // 3
        self.sink.write(struct.pack("<II", SKIP_INDEX, len(self.docs)))
        self.sink.write(bytes(self.docs))
        self.sink.write(struct.pack("<II", SKIP_SEEK, n * 12 + 9))
        self.sink.write(self.sizes.tobytes())
        self.sink.write(struct.pack("<IBI", n, 0x80, SEEK_MAGIC))

    def spans(self, step: int) -> list[dict]:
        """Where every step-th frame, and its first id among those of the file, begin."""
        sizes = np.frombuffer(self.sizes, "<u4").reshape(-1, 3).astype(np.int64)
        return [{"at": i, "byte": int(sizes[:i, 0].sum()), "token": int(sizes[:i, 1].sum()) // 4} for i in range(0, len(sizes), step)]


class FrameReader:
    """Random access to the documents of a file (anything with seek and read), of frames first to last only if asked so.

    first_byte says where the first of them begins; without it the sizes of those before it are read, too.
    """

    def __init__(self, source, first: int = 0, last: int | None = None, first_byte: int | None = None):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.n, at = n, end - 9 - 12 * n - 8
        source.seek(at)
        if struct.unpack("<II", source.read(8)) != (SKIP_SEEK, n * 12 + 9):
            raise ValueError("broken seek table")
        self.first = 0 if first_byte is None else first
        stop = n if last is None else min(n, last)
        source.seek(at + 8 + 12 * self.first)
        self.sizes = np.frombuffer(source.read(12 * (stop - self.first)), "<u4").reshape(-1, 3).astype(np.int64)
        source.seek(at - 9 * (n - self.first))
        self.docs = source.read(9 * (stop - self.first))
        self.starts = np.r_[0, np.cumsum(self.sizes[:, 0])] + (first_byte or 0)
        #: Ids before each frame, counted from the first one.
        self.tokens = np.r_[0, np.cumsum(self.sizes[:, 1] // 4)]
        self.unpacker = zstandard.ZstdDecompressor()

    def doc_id(self, i: int) -> int | None:
        doc_id, known = struct.unpack_from("<qB", self.docs, 9 * (i - self.first))
        return doc_id if known else None

    def content(self, i: int) -> bytes:
        packed, size, check = map(int, self.sizes[i - self.first])
        self.source.seek(int(self.starts[i - self.first]))
        got = self.unpacker.decompress(self.source.read(packed), max_output_size=size)
        if len(got) != size or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return got


_MANIFEST = "part int, file string, n_docs long, n_tokens long, spans array<struct<at:long,byte:long,token:long>>"


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write (doc_id, text) to files in folder (a URI that tasks can reach); returns the committed manifest."""

    def make(rows):
        from pyspark import TaskContext

        first = next(rows, None)
        if first is None:
            return
        words = words_of(tokenizer)
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name, n, total = f"ids-{part:06d}-{uuid.uuid4().hex}.zst", 0, 0
        with system.open_output_stream(f"{at}/{name}", compression=None) as sink:
            out = FrameWriter(sink)
            rest = chain([first], rows)
            while some := list(islice(rest, _TOGETHER)):
                for r, ids in zip(some, words.ids([r["text"] for r in some]), strict=True):
                    out.add(r["doc_id"], ids)
                    total += len(ids) // 4
                n += len(some)
            out.close()
        yield {"part": part, "file": f"{folder}/{name}", "n_docs": n, "n_tokens": total, "spans": out.spans(SPAN)}

    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(map_rows(dealt, make, _MANIFEST), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the tokens before it."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    files = manifest.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spans = files.select("file", "file_start", F.explode("spans").alias("span")).select("file", "file_start", "span.*")

    def make(rows):
        for r in rows:
            system, path = file_system(r["file"])
            with system.open_input_file(path) as source:
                reader = FrameReader(source, r["at"], r["at"] + SPAN, r["byte"])
                start = r["file_start"] + r["token"]
                for i in range(len(reader.sizes)):
                    got = reader.content(r["at"] + i)
                    yield {"doc_id": reader.doc_id(r["at"] + i), "start": start + int(reader.tokens[i]), "n_tokens": len(got) // 4, "ids_crc32": zlib.crc32(got)}

    # a count of its own: rows are a few bytes, so by size alone they would all be put into one task
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_docs") / SPAN))).first()[0] or 1
    return map_rows(spans.repartition(int(min(tasks, MOST_TASKS)), "file", "at"), make, "doc_id long, start long, n_tokens long, ids_crc32 long", 2048)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files")))
