"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked within 3 bits.

Candidates come from a segment-popcount embedding. A fingerprint is cut into 32 segments of two bits;
the vector of their bit counts differs between two fingerprints by at most their Hamming distance, in
Manhattan distance. So fingerprints within 3 bits have Manhattan distance 3 at most, and on one half
of the 32 segments 1 at most. Each half is a grid of unit cells: a fingerprint lies in one cell and
probes that cell and the cells one step up, an equi-join that finds all pairs within Manhattan
distance 1 on that half. The other half then lies within 3, so one of its four quarters at least has
equal counts, which the join key holds, too: four times the rows, a fiftieth of the candidates for each.
Candidates are verified exactly by the bit count of the exclusive or.

Only distinct fingerprints enter the join, so a group of copies, however large, is one row there; the
number of distinct fingerprints in a small Hamming ball is bounded by the ball, not by the corpus.
Large cells and hot fingerprints are left to adaptive skew joins, which can split all joins here.

Defined cases of the operator: null and empty texts and texts without words have fingerprint zero and link like any
other; texts with fewer than 3 words have one shingle; repeated rows are rows of their own; a row with
a null id belongs to its group but never names it; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_rows, marked, materialise, numbered, pages, table

SHINGLE = 3
SEED = 42
DISTANCE = 3
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        ends, starts = [len(line)], [0]
    else:
        ends = list(accumulate(map(len, words)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends[: -SHINGLE])]
        ends = ends[SHINGLE - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = counts * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fp long)."""

    def make(rows):
        for r in rows:
            yield {"doc_id": r["doc_id"], "fp": fingerprint(r["text"])}

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def popcounts(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a 32-bit half, packed two bits each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def links(distinct_fp: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in column fp with 1 to DISTANCE differing bits; a pair may come more than once."""
    low, high = popcounts(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), popcounts(F.shiftrightunsigned(F.col("fp"), 32))
    cells = distinct_fp.select("fp", F.posexplode(F.array(F.struct(low.alias("cell"), high.alias("rest")), F.struct(high.alias("cell"), low.alias("rest")))).alias("half", "c"))
    # where in the other half's quarters: half, quarter and the quarter's counts, above the cell's 32 bits
    quarters = F.array(*[F.shiftleft((F.col("half") * 4 + q) * 256 + F.shiftright(F.col("c.rest"), 8 * q).bitwiseAND(F.lit(255)), 32) for q in range(4)])
    cells = cells.select("fp", F.col("c.cell").alias("cell"), F.explode(quarters).alias("above"))
    home = cells.select(F.col("fp").alias("b"), (F.col("above") + F.col("cell")).alias("key"))
    steps = F.array(*[F.when(F.shiftright(F.col("cell"), 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + (1 << 2 * i)) for i in range(16)])
    probes = cells.select(F.col("fp").alias("a"), "above", F.explode(F.array_compact(F.concat(F.array("cell"), steps))).alias("cell"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    # never a broadcast: Spark's estimate of home is that of its table, of which each row has become eight
    return probes.select("a", (F.col("above") + F.col("cell")).alias("key")).join(home.hint("merge"), "key").where((F.col("a") != F.col("b")) & near).select("a", "b")


def labels(distinct_fp: DataFrame) -> DataFrame:
    """(fp, label) of the fingerprints in column fp: the smallest fingerprint reachable over links."""
    named = materialise(components(links(distinct_fp)), "components")
    return distinct_fp.join(named, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("component_id", "fp").alias("label"))


def groups(fps: DataFrame) -> DataFrame:
    """(doc_id, fp) to (fp, component_id): the smallest doc_id reachable over links, for each fingerprint."""
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    member = labels(reps.select("fp")).join(reps, "fp")
    lowest = member.groupBy("label").agg(F.min("rep").alias("component_id"))
    return member.join(lowest, "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    fps = materialise(fingerprints(docs), "fingerprints")
    return fps.join(groups(fps), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, null last; of several, that with the smallest text hash, then any.

    Rows are told apart by a number, not by id: texts of different groups that share an id, or have none, are kept all.
    The rows keep their columns, whatever the names.
    """
    rows = numbered(docs, "rows")
    every = rows.select("n", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("tie"), "row.text")

    def make(rows):
        for r in rows:
            r["fp"] = fingerprint(r.pop("text"))
            yield r

    fps = map_rows(every, make, "n long, id long, tie long, fp long")
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "n")).alias("first"))
    first = materialise(first, "reps")
    kept = first.join(labels(first.select("fp")), "fp").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.n").alias("n"))
    return marked(rows, pages(kept, "kept", kept=F.lit(True))).where("kept").select("row.*")
