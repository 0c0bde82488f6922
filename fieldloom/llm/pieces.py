"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The vocabulary files at hand hold a BPE model, whose encoding is the one sequence of pieces in which
every piece and every two neighbours are what the merges themselves make of them. That makes encoding
a best-path problem: a step from a piece to the next weighs 0 if the two may stand side by side and
minus infinity if not, and the encoding is the only path with weight 0. So giant documents need no
left-to-right pass. They are cut into chunks; a chunk's states are the pieces that may cover its left
and its right cut, and its transfer matrix holds the best weight from each to each. The matrices are
combined associatively (max-plus products, doubling), which fixes the state at every cut, and each
chunk is then backtraced by itself. Where a cut falls on a word boundary, which no piece crosses, it
has one state. Documents up to GIANT characters are one chunk, with one state on either side.

No piece spans two characters that stand side by side in none of the pieces, so a word falls apart there;
words and such parts are kept by text, since most come again.

Results are those of the sentencepiece library for the same file.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become byte pieces;
a literal U+2581 is a space, as in the library; repeated rows and null ids are rows of their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialise, table

SPACE = "▁"
#: Documents over so many characters are cut into chunks of CHUNK characters.
GIANT = 1 << 15
CHUNK = 1 << 13
#: A cut moves right to the next word boundary if there is one so near.
SNAP = 256
#: Words of a generation that are kept with their ids; those in use pass on to the next.
_CACHE = 250_000
_PAIRS = 1_000_000
#: Words of letters alone, up to so many characters, are not searched for places where they part.
_WORD = 24


class PieceModel:
    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.bytes = {}, {}, {}
        self.raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.known = set(chain.from_iterable(self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or "\n" in self.known:
            raise ValueError("pieces of this model cross word boundaries")
        self._pair: dict[int, bool] = {}
        #: Ids of the pieces that their own merges give; no encoding holds another.
        self.sound = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self._name = {i: p for p, i in self.sound.items()}
        self._made: dict[int, dict[int, tuple[list[float], list[str]]]] = {0: {}, -1: {}}
        #: Lengths of the sound pieces that begin with three characters, longest first; one or two where these are no key.
        self._lengths: dict[str, tuple[int, ...]] = {}
        for size in sorted({len(p) for p in self.sound} - {1, 2}, reverse=True):
            for head in {p[:3] for p in self.sound if len(p) == size}:
                self._lengths[head] = (*self._lengths.get(head, ()), size)
        self._lengths = {head: (*sizes, 2, 1) if head[:2] in self.sound else (*sizes, 1) for head, sizes in self._lengths.items()}
        #: Pairs of characters that some piece holds side by side; all others part a text.
        self._joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._segment = _Cache(self._encode_segment)
        self._split = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+").findall

    def merge(self, text: str) -> list[str]:
        """The merges themselves, for a few characters: best score first, then leftmost."""
        parts, score, none = list(text), self.score.get, -np.inf
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > none:
            i = gains.index(best)
            parts[i] += parts.pop(i + 1)
            del gains[i]
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Weight 0 rather than minus infinity for the step from a to b, each sound or a character of no piece; a == "" is a start."""
        i, j = self.sound.get(a), self.sound.get(b)
        if i is None or j is None:  # nothing merges with a start or with a character of no piece
            return True
        got = self._pair.get(i * len(self.raw) + j)
        return self._fits(i, j) if got is None else got

    def _steps(self, i: int, end: int) -> tuple[list[float], list[str]]:
        """Scores of the merges that make piece i, in order, and its first (0) or last (-1) part before each and after all."""
        got = self._made[end].get(i)
        if got is None:
            parts, score, none = list(self._name[i]), self.score.get, -np.inf
            gains, edge = [], [parts[end]]
            while len(parts) > 1:
                now = [score(a + b, none) for a, b in zip(parts, parts[1:])]
                at = now.index(max(now))
                gains.append(now[at])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                edge.append(parts[end])
            got = self._made[end][i] = ([*gains, none], edge)
        return got

    def _fits(self, i: int, j: int) -> bool:
        """Whether the merges of i and j, side by side and best first, end before one across their border is best."""
        if len(self._pair) > _PAIRS:
            self._pair.clear()
        (left, lasts), (right, firsts), p, q, none = self._steps(i, -1), self._steps(j, 0), 0, 0, -np.inf
        while True:
            across = self.score.get(lasts[p] + firsts[q], none)
            if left[p] >= across and left[p] >= right[q]:  # leftmost of equals
                if left[p] == none:
                    break
                p += 1
            elif right[q] > across:
                q += 1
            else:
                break
        got = self._pair[i * len(self.raw) + j] = left[p] == right[q] == across
        return got

    def _pieces_at(self, text: str, start: int):
        """Pieces of text from start on; a character in no piece stands for itself."""
        yield text[start]
        if text[start] in self.known:
            for end in range(start + 2, min(len(text), start + self.longest) + 1):
                if text[start:end] in self.sound:
                    yield text[start:end]

    def paths(self, text: str, at: int, last: str, upto: int) -> list[str | None]:
        """For each end position, the last piece of the weight-0 path that begins after `last` (which ends at `at`).

        Pieces begin before `upto` and may end after it. Positions that no such path ends at hold None.
        """
        ends: list[str | None] = [None] * (len(text) + 1)
        ends[at] = last
        for start in range(at, upto):
            before = ends[start]
            if before is None:
                continue
            for piece in self._pieces_at(text, start):
                if ends[start + len(piece)] is None and (before == "" or self.may_follow(before, piece)):
                    ends[start + len(piece)] = piece
        return ends

    def trace(self, ends: list[str | None], at: int, end: int) -> list[str]:
        out = []
        while end > at:
            out.append(ends[end])
            end -= len(ends[end])
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def _encode_segment(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment: its parts', one after another. A part is a segment of its own."""
        if len(segment) <= _WORD and segment[1:].isalpha():
            return self._encode_part(segment)
        joined = self._joined
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in joined]
        if not cuts:
            return self._encode_part(segment)
        return tuple(chain.from_iterable([self._segment[segment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(segment)])]))

    def _encode_part(self, segment: str) -> tuple[int, ...]:
        """Ids of the path of weight 0 through a part, depth first and longest piece first.

        All that leads to a position with weight 0 ends in the same piece, so no position is tried twice.
        """
        n, size, sound, pair, lengths = len(segment), len(self.raw), self.sound.get, self._pair.get, self._lengths.get
        tried, ends, out, at, last, upto = bytearray(n + 1), [0], [], 0, -1, n
        while at < n:
            for long in lengths(segment[at : at + 3], (2, 1)):
                end = at + long
                if end > upto or tried[end]:
                    continue
                i = sound(segment[at:end])
                if i is None:
                    if long > 1:
                        continue
                    i = -1  # a character of no piece
                elif last >= 0:
                    fits = pair(last * size + i)
                    if not (self._fits(last, i) if fits is None else fits):
                        continue
                tried[end] = 1
                ends.append(end)
                out.append(i)
                at, last, upto = end, i, n
                break
            else:  # a dead end: the next shorter piece in place of the last one
                upto = ends.pop() - 1
                out.pop()
                at, last = ends[-1], out[-1] if out else -1
        if -1 in out:
            return tuple(self.to_ids([segment[a:b] for a, b in zip(ends, ends[1:])]))
        return tuple(out)

    def encode_words(self, normal: str) -> list[int]:
        """Ids of normalised text that starts and ends on a word boundary."""
        return list(chain.from_iterable(map(self._segment.__getitem__, self._split(normal))))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_words(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids) -> str:
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    # giant documents

    def boundary(self, normal: str, at: int) -> bool:
        return at in (0, len(normal)) or normal[at] == "\n" or normal[at - 1] == "\n" or normal[at] == SPACE != normal[at - 1]

    def cuts(self, normal: str, chunk: int = CHUNK) -> list[int]:
        out, at = [0], chunk
        while at < len(normal):
            cut = next((i for i in range(at, min(at + SNAP, len(normal))) if self.boundary(normal, i)), at)
            out.append(cut)
            at = cut + chunk
        return [*out, len(normal)] if out[-1] < len(normal) else out

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that may begin before cut and end at or after it; (cut, cut) alone on a boundary."""
        if self.boundary(text, cut):
            return [(cut, cut)]
        out = []
        for start in range(max(0, cut - self.longest), cut):
            out += [(start, start + len(p)) for p in self._pieces_at(text, start) if start + len(p) >= cut]
        return out

    def _inner(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """First and last word boundary from left to right, both included."""
        head = next((i for i in range(left, right + 1) if self.boundary(text, i)), None)
        if head is None:
            return None
        return head, next(i for i in range(right, head - 1, -1) if self.boundary(text, i))

    def _reaches(self, text: str, ends: list[str | None], state: tuple[int, int]) -> bool:
        s, e = state
        return ends[s] is not None and (s == e or ends[s] == "" or self.may_follow(ends[s], text[s:e]))

    def transfer(self, text: str, left: int, right: int) -> np.ndarray:
        """Weights from each state at left to each state at right: 0 or minus infinity."""
        ins, outs, inner = self.states(text, left), self.states(text, right), self._inner(text, left, right)
        m = np.full((len(ins), len(outs)), -np.inf)
        if inner:
            head, tail = inner
            u = [a == b == head or self.paths(text, b, text[a:b], head)[head] is not None for a, b in ins]
            ends = self.paths(text, tail, "", right)
            v = [self._reaches(text, ends, state) for state in outs]
            m[np.ix_(u, v)] = 0
            return m
        for i, (a, b) in enumerate(ins):
            if b >= right:
                m[i, [state == (a, b) for state in outs]] = 0
            else:
                ends = self.paths(text, b, text[a:b], right)
                m[i, [s >= b and self._reaches(text, ends, (s, e)) for s, e in outs]] = 0
        return m

    def backtrace(self, text: str, left: int, right: int, come: int, go: int) -> list[int]:
        """Ids of the pieces that begin at or after the end of state `come` at left, up to state `go` at right with it."""
        (a, b), (s, e), inner = self.states(text, left)[come], self.states(text, right)[go], self._inner(text, left, right)
        over = [text[s:e]] if s < e else []
        if inner:
            head, tail = inner
            first = self.trace(self.paths(text, b, text[a:b], head), b, head)
            last = self.trace(self.paths(text, tail, "", s), tail, s)
            return self.to_ids(first) + self.encode_words(text[head:tail]) + self.to_ids(last + over)
        if b >= right:
            return []
        return self.to_ids(self.trace(self.paths(text, b, text[a:b], s), b, s) + over)


class _Cache(dict):
    """Ids by segment, in two generations: those that come again in the second pass back to the first. Long segments aren't kept.

    Tuples of numbers, which the garbage collector leaves out.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 48:
            if len(self) >= _CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


_MODELS: dict[str | None, PieceModel] = {}


def model(path: str | None = None) -> PieceModel:
    """One a worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all prefixes, by doubling: an associative scan of depth log n."""
    done, step = list(matrices), 1
    while step < len(done):
        done = [done[i] if i < step else max_plus(done[i - step], done[i]) for i in range(len(done))]
        step *= 2
    return done


def cut_states(matrices: list[np.ndarray]) -> list[int]:
    """State at the right of each chunk on the one path from the first cut's state to the last's."""
    ahead = scan(matrices)
    behind = [m.T for m in scan([m.T for m in reversed(matrices)])][::-1][1:]
    return [int((a[0] + b[:, 0]).argmax()) for a, b in zip(ahead, behind, strict=False)] + [0]


def _chunk_rows(docs: DataFrame, path: str | None, chunk: int) -> DataFrame:
    def make(rows):
        m = model(path)
        for r in rows:
            normal = SPACE + r["text"].replace(" ", SPACE)
            cuts, pad = m.cuts(normal, chunk), m.longest + 1
            for k, (left, right) in enumerate(zip(cuts, cuts[1:], strict=False)):
                at, end = max(0, left - pad), min(len(normal), right + pad)
                yield {"piece_row": r["piece_row"], "doc_id": r["doc_id"], "chunk": k, "part": normal[at:end], "lo": left - at, "hi": right - at, "first": at == 0, "last": end == len(normal)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, make, f"piece_row long, doc_id {kind}, chunk int, part string, lo int, hi int, first boolean, last boolean", 64)


def _open(r: dict) -> tuple[str, int, int]:
    """The part with a neutral character where the text goes on, so that only true ends look like ends."""
    head = "" if r["first"] else "▂"
    return head + r["part"] + ("" if r["last"] else "▂"), r["lo"] + len(head), r["hi"] + len(head)


def encode_giants(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) to (doc_id, ids), by chunks, whatever the length."""
    numbered = docs.where("text is not null and text <> ''").withColumn("piece_row", F.monotonically_increasing_id())
    chunks = materialise(_chunk_rows(numbered, path, chunk), "chunks")
    dealt = chunks.repartition("piece_row", "chunk")

    def transfers(rows):
        m = model(path)
        for r in rows:
            got = m.transfer(*_open(r))
            yield {"piece_row": r["piece_row"], "chunk": r["chunk"], "ins": got.shape[0], "zeros": np.flatnonzero(got.ravel() == 0).tolist(), "outs": got.shape[1]}

    moved = map_rows(dealt, transfers, "piece_row long, chunk int, ins int, outs int, zeros array<int>", 64)

    def combine(pdf):
        pdf = pdf.sort_values("chunk")
        matrices = []
        for ins, outs, zeros in zip(pdf["ins"], pdf["outs"], pdf["zeros"], strict=True):
            m = np.full(ins * outs, -np.inf)
            m[np.asarray(zeros, dtype=int)] = 0
            matrices.append(m.reshape(ins, outs))
        go = cut_states(matrices)
        return pdf[["piece_row", "chunk"]].assign(come=[0, *go[:-1]], go=go)

    # small matrices only, of one document a group: a text of the largest size Spark can hold has some 2^18
    fixed = moved.groupBy("piece_row").applyInPandas(combine, "piece_row long, chunk int, come int, go int")

    def back(rows):
        m = model(path)
        for r in rows:
            yield {"piece_row": r["piece_row"], "doc_id": r["doc_id"], "chunk": r["chunk"], "ids": m.backtrace(*_open(r), r["come"], r["go"])}

    kind = docs.schema["doc_id"].dataType.simpleString()
    traced = map_rows(chunks.join(fixed, ["piece_row", "chunk"]), back, f"piece_row long, doc_id {kind}, chunk int, ids array<int>", 64)
    whole = traced.groupBy("piece_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"))


def encode(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK, more=None, more_schema: str = "") -> DataFrame:
    """(doc_id, text) to (doc_id, ids array<int>), and what more(model, ids) makes of each document's ids, with its schema.

    more runs where the ids are made, so that they needn't come back to Python; only giants' do, whose chunks meet in Spark.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + (f", {more_schema}" if more else "")

    def whole(batch):
        m = model(path)
        for r in batch:
            ids = m.encode(r["text"])
            yield {"doc_id": r["doc_id"], "ids": ids} | (more(m, ids) if more else {})

    def added(batch):
        m = model(path)
        for r in batch:
            yield r | more(m, r["ids"].tolist())

    small = map_rows(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= giant), whole, schema)
    large = encode_giants(rows.where(F.length("text") > giant), path, chunk)
    return small.unionByName(map_rows(large, added, schema, 16, arrays=("ids",)) if more else large)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, text)."""

    def make(rows):
        m = model(path)
        for r in rows:
            yield {"doc_id": r["doc_id"], "ids": r["ids"], "text": m.decode(r["ids"].tolist() if r["ids"] is not None else [])}

    kind = coded.schema["doc_id"].dataType.simpleString()
    return map_rows(coded.select("doc_id", "ids"), make, f"doc_id {kind}, ids array<int>, text string", arrays=("ids",))


def _digests(m: PieceModel, ids: list[int]) -> dict:
    text = m.decode(ids).encode("utf-8", "surrogatepass")
    return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(array("I", ids)), "decoded_crc32": zlib.crc32(text)}


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their count and CRC-32 (little-endian 32-bit), and the CRC-32 of the text decoded from them."""
    return encode(table(spark, sf_dir, "documents"), more=_digests, more_schema="n_tokens long, ids_crc32 long, decoded_crc32 long")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of the documents that reach this stage."""
    return encode(docs)
