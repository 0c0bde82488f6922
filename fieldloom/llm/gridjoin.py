"""Embedding near-duplicates: an epsilon grid order join.

Unit vectors with cosine t or more lie within epsilon = sqrt(2 - 2t). Vectors are projected on the
leading principal axes of a bounded sample (an orthonormal basis, so projected distances never exceed
true ones; the length of what the projection leaves out is one more coordinate, which keeps that) and
sorted by label, then by their grid cells of side epsilon on these axes in turn. Runs
of up to RUN consecutive vectors are the sequences: pairs of runs that share or neighbour a cell of the
first axis are found by an equi-join, those whose boxes lie further apart than epsilon are dropped, and
each pair that is left is one group of at most 2 * RUN rows. Inside, the two sequences are halved
recursively; a pair of parts whose boxes are provably distant is skipped, and small parts, or larger ones
whose halves are all near, are compared in double precision by a matrix product. Equal unit vectors are one
row with a count until the end. Each group returns link counts and a spanning forest, at most
one edge a vector, so that thousands of copies never become all their pairs.

What the boxes skip depends on the vectors. Those that form clusters, as embeddings do, leave few pairs of
parts; directions spread evenly over many dimensions leave nearly all, and then a label's work grows with
the square of its vectors, as matrix products, and a row is shuffled once for every RUN vectors near it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, link with nothing; vectors of different lengths don't link; rows that share a vec_id
are one vector, the least by label and embedding; a null vec_id is a vector with a null component; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_rows, materialise, np_components, table

THRESHOLD = 0.98
#: The axes are fitted on so many vectors at most (those with the smallest hash); they decide speed, not results.
SAMPLE = 4096
AXES = 16
RUN = 16384
#: Bytes of a run's vectors, at most; long vectors make shorter runs.
RUN_BYTES = 16 << 20
LEAF = 32
#: Parts of so many rows are compared whole where all pairs of their halves come within epsilon.
BLOCK = 128


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions of a bounded sample, by vector length."""
    got = vectors.select("vec_id", "dim", "unit").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    out = {}
    for dim in {r.dim for r in got}:
        x = np.stack([np.frombuffer(r.unit) for r in got if r.dim == dim])
        _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        out[dim] = np.ascontiguousarray(vt[:AXES].T)
    return out


def _project(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Coordinates on the axes, and the length of the rest."""
    basis = np.eye(x.shape[1], min(AXES, x.shape[1])) if basis is None else basis
    p = x @ basis
    rest = np.linalg.norm(x - p @ basis.T, axis=1)
    return np.c_[np.pad(p, ((0, 0), (0, AXES - p.shape[1]))), rest]


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit) of the vectors that can link; unit holds doubles."""

    def make(rows):
        for r in rows:
            if None not in r["embedding"]:
                x = np.asarray(r["embedding"], dtype=float)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    yield {"vec_id": r["vec_id"], "label": r["label"], "dim": len(x), "unit": (x / np.linalg.norm(x)).tobytes()}

    usable = vectors.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    return map_rows(usable, make, "vec_id long, label long, dim int, unit binary", 2048).withColumn("same", F.unhex(F.md5("unit")))


def _distinct(valid: DataFrame) -> DataFrame:
    """One row for equal unit vectors of a label: (vec_id, label, dim, same, unit, copies), the least vec_id and how many there are."""
    return valid.groupBy("label", "dim", "same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))


def _with_cells(vectors: DataFrame, basis: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    def make(rows):
        for r in rows:
            p = _project(np.frombuffer(r["unit"])[None], basis.get(r["dim"]))[0]
            yield r | {"cells": np.floor(p[:AXES] / epsilon).astype(int).tolist(), "spot": p.tolist()}

    return map_rows(vectors, make, "vec_id long, copies long, label long, dim int, unit binary, cells array<int>, spot array<double>", 2048)


def _runs(ordered: DataFrame) -> DataFrame:
    """Adds run: consecutive vectors of one label and length in a partition, at most RUN of them and RUN_BYTES."""

    from pyspark import TaskContext

    def make(rows):
        part, n, size, at = TaskContext.get().partitionId(), -1, RUN, None
        for r in rows:
            if size >= min(RUN, max(LEAF, RUN_BYTES // (8 * r["dim"]))) or (r["label"], r["dim"]) != at:
                n, size, at = n + 1, 0, (r["label"], r["dim"])
            size += 1
            yield r | {"run": (part << 32) + n}

    return map_rows(ordered, make, "vec_id long, copies long, label long, dim int, unit binary, cells array<int>, spot array<double>, run long", 2048)


def run_pairs(runs: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (run, other), run <= other, whose boxes come within epsilon."""
    box = runs.groupBy("label", "dim", "run").agg(
        *[F.min(F.col("spot")[i]).alias(f"lo{i}") for i in range(AXES + 1)],
        *[F.max(F.col("spot")[i]).alias(f"hi{i}") for i in range(AXES + 1)],
        F.min(F.col("cells")[0]).alias("c_lo"),
        F.max(F.col("cells")[0]).alias("c_hi"),
    )
    near = box.select("*", F.explode(F.sequence("c_lo", "c_hi")).alias("cell"))
    far = box.select(*[F.col(c).alias(f"o_{c}") for c in box.columns], F.explode(F.sequence(F.col("c_lo") - 1, F.col("c_hi") + 1)).alias("o_cell"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"o_hi{i}"), F.col(f"o_lo{i}") - F.col(f"hi{i}")), F.lit(2.0)) for i in range(AXES + 1)), F.lit(0.0))
    same = [F.col("label") == F.col("o_label"), F.col("dim") == F.col("o_dim"), F.col("cell") == F.col("o_cell")]
    return near.join(far, same).where((F.col("run") <= F.col("o_run")) & (gap <= epsilon * epsilon)).select("run", F.col("o_run").alias("other")).distinct()


class _Boxes:
    """Bounds of the rows of parts of a sequence, each found once from its halves."""

    def __init__(self, p: np.ndarray):
        self.p, self.held = p, {}

    def __call__(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.held.get((a, b))
        if got is None:
            if b - a <= LEAF:
                got = self.p[a:b].min(0), self.p[a:b].max(0)
            else:
                m = (a + b) // 2
                (low, high), (low2, high2) = self(a, m), self(m, b)
                got = np.minimum(low, low2), np.maximum(high, high2)
            self.held[a, b] = got
        return got


def _halves(a: int, b: int) -> list[tuple[int, int]]:
    return [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]


def near_parts(p: np.ndarray, q: np.ndarray, epsilon: float, same: bool):
    """Pairs of parts (a, b, c, d) of the sequences p and q, rows a to b and c to d, whose boxes come within epsilon.

    Parts are halved down to LEAF rows while that skips anything: from BLOCK rows on, where no pair of halves is apart, the
    parts stay whole, as one product of more rows is cheaper than four of half as many.
    """
    box_p = _Boxes(p)
    box_q = box_p if q is p else _Boxes(q)

    def near(a, b, c, d):
        (low, high), (low2, high2) = box_p(a, b), box_q(c, d)
        gap = np.maximum(0, np.maximum(low - high2, low2 - high))
        return gap @ gap <= epsilon * epsilon

    stack = [(0, len(p), 0, len(q))] if len(p) and len(q) and near(0, len(p), 0, len(q)) else []
    while stack:
        a, b, c, d = stack.pop()
        pairs = [(*s, *t) for s in _halves(a, b) for t in _halves(c, d)]
        wanted = [x for x in pairs if not (same and x[0] >= x[3]) and near(*x)]
        if len(pairs) == 1 or max(b - a, d - c) <= BLOCK and len(wanted) == sum(not (same and x[0] >= x[3]) for x in pairs):
            yield a, b, c, d
        else:
            stack += wanted


def join_sequences(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, threshold: float, epsilon: float, same: bool, weights: np.ndarray | None = None):
    """Link counts of x's and y's rows and edges (i, j) over the joint numbering that connect what links connect.

    p and q are the projections. With same, y is x, and pairs are those with i < j. A link to a row counts its weight, 1 if
    there are none.
    """
    n = len(x)
    counts = np.zeros(n if same else n + len(y), dtype=np.int64)
    weights = np.ones(len(counts), dtype=np.int64) if weights is None else weights
    heads, tails, shift = [], [], 0 if same else n
    for a, b, c, d in near_parts(p, p if same else q, epsilon, same):
        hit = x[a:b] @ y[c:d].T >= threshold
        if same:
            hit &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        i, j = i + a, j + c + shift
        np.add.at(counts, i, weights[j])
        np.add.at(counts, j, weights[i])
        # a spanning forest of this block's links
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        inner = np_components(len(rows), at[: len(i)], at[len(i) :])
        moved = np.flatnonzero(inner != np.arange(len(rows)))
        heads.append(rows[moved])
        tails.append(rows[inner[moved]])
    if not heads:
        return counts, np.zeros(0, int), np.zeros(0, int)
    label = np_components(len(counts), np.concatenate(heads), np.concatenate(tails))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return counts, moved, label[moved]


def link_stars(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n, other) of distinct unit vectors: link counts, copies included, by group of runs, and a linked vec_id or null."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-12
    celled = _with_cells(vectors.select("vec_id", "copies", "label", "dim", "unit"), axes(vectors), epsilon)
    order = ["label", "dim", *[F.col("cells")[i] for i in range(AXES)], F.xxhash64("vec_id")]
    # numbering runs by partition and place: written before it is used, so that every reader sees the same runs
    runs = materialise(_runs(celled.repartitionByRange(*order).sortWithinPartitions(*order)), "runs")
    pairs = materialise(run_pairs(runs, epsilon), "pairs")
    sides = pairs.select("run", "other", F.col("run").alias("own")).union(pairs.where("run <> other").select("run", "other", F.col("other").alias("own")))
    rows = runs.select(F.col("run").alias("own"), "vec_id", "copies", "unit", "spot").join(sides, "own")

    def compare(key, t):
        import pyarrow as pa

        own, ids, copies = t["own"].to_numpy(), t["vec_id"].to_numpy(), t["copies"].to_numpy()
        x = np.frombuffer(b"".join(t["unit"].to_pylist())).reshape(len(ids), -1)
        p = np.array(t["spot"].to_pylist())
        first = own == key[0].as_py()
        at = np.r_[np.flatnonzero(first), np.flatnonzero(~first)]
        # in grid order again, which the shuffle lost, so that halves are compact
        at = at[np.lexsort((*np.floor(p[at, :AXES] / epsilon).T[::-1], ~first[at]))]
        x, p, ids, copies, k = x[at], p[at], ids[at], copies[at], int(first.sum())
        same = k == len(ids)
        counts, head, tail = join_sequences(x[:k], p[:k], x if same else x[k:], p if same else p[k:], threshold, epsilon, same, copies)
        other = np.full(len(ids), -1)
        other[head] = tail
        at = np.flatnonzero(counts)
        return pa.table({"vec_id": pa.array(ids[at], pa.int64()), "n": pa.array(counts[at], pa.int64()), "other": pa.array([int(ids[o]) if o >= 0 else None for o in other[at]], pa.int64())})

    return rows.groupBy("run", "other").applyInArrow(compare, "vec_id long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    one = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    one = materialise(one.select("vec_id", "v.label", "v.embedding"), "vectors")
    valid = materialise(_valid(one), "unit")
    own = materialise(_distinct(valid), "distinct")
    stars = materialise(link_stars(own, threshold), "stars")
    comp = components(stars.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    found = stars.groupBy("vec_id").agg(F.sum("n").alias("n_links")).join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    # a copy links with the other copies and with all that one of them links with
    links = F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1
    named = own.select("vec_id", "label", "dim", "same", "copies").join(found, "vec_id", "left").select("label", "dim", "same", links.alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    members = valid.select("vec_id", "label", "dim", "same").join(named, ["label", "dim", "same"]).select("vec_id", "n_links", "component_id")
    out = one.select("vec_id").join(members, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
