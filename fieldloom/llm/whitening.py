"""Embedding whitening by a tiled covariance.

Entries become whole numbers x = floor(64 c) + 1000000. Their columns are cut into blocks of TILE dimensions and
their rows into blocks of ROWS vectors; a tile is a pair of column blocks. Every column block of a row block travels
to the tiles it is part of, in the narrowest integers that hold it; there, the two blocks of a pair are centred and
multiplied, and products are summed per tile: first in the task that has them, then over tasks. A tile's rows may be
dealt over SPREAD tasks. Only the assembled matrix, whose size is that of the dimensions, comes to the driver, which
decomposes it; the rows are then projected where they lie. The same tiles give the covariance of the whitened rows.

Centring is exact: n x - S is computed in whole numbers and divided by n once, before multiplying.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped, as are those with an entry
whose x is no 62-bit number; of vectors of several lengths, those of the most frequent length remain (of equally
frequent ones, the longest); rows that share a vec_id, or have none, are rows of their own; components without variance
(an eigenvalue within rounding of zero) have a null whitened value and take no part in identity_error; a deviation
that no long holds is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

COMPONENTS = 32
TILE = 32
ROWS = 4096
#: Tasks that the row blocks of one tile are dealt over.
SPREAD = 64
_SCALE, _SHIFT = 64, 1_000_000


def whole_numbers(c: np.ndarray) -> np.ndarray:
    """floor(64 c) of each entry; Python's integers if 64-bit ones could not be multiplied further."""
    x = np.floor(_SCALE * c)
    if x.size and np.abs(x).max() >= 1 << 50:
        return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S, exactly. x and S without the shift, which cancels out."""
    if x.dtype != object and n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61 and np.abs(total).max(initial=0) < 1 << 61:
        return x * n - total.astype(np.int64)
    return x.astype(object) * n - total


def squared_lengths(d: np.ndarray) -> list[int | None]:
    if d.dtype != object and (d.astype(float) ** 2).sum(1).max(initial=0) < 9e18:
        return (d * d).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in d)]


def _matrix(batch, dim: int | None = None) -> tuple[list, dict[int, np.ndarray]]:
    """vec_id and entries of the usable vectors of a batch, by length; of one length only if dim is given."""
    import pyarrow.compute as pc

    out, column = {}, batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    for size in {dim} if dim else set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == size)
        c = column.take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)  # null becomes NaN
        fits = (np.abs(c) * _SCALE < 1 << 62).all(1)
        out[size] = (batch.column("vec_id").take(at[fits]), c[fits])
    return out


@dataclass
class Fit:
    """What is fitted: n vectors of `dim` entries, their sums without the shift, unit eigenvectors and eigenvalues."""

    n: int
    dim: int
    total: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def defined(self) -> np.ndarray:
        return self.values > max(self.values.max(initial=0), 0) * self.dim * 4 * np.finfo(float).eps


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def sums(vectors: DataFrame) -> tuple[int, int, np.ndarray]:
    """(n, dimensions, exact sums) of the most frequent length."""
    import pyarrow as pa

    def make(batches):
        held: dict[int, list] = {}
        for b in batches:
            for size, (_, c) in _matrix(b).items():
                if len(c):
                    n, total = held.get(size, (0, 0))
                    held[size] = (n + len(c), total + whole_numbers(c).sum(0).astype(object))
        for size, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [size], "n": [n], "total": [[str(v) for v in total]]}, schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))]))

    parts = vectors.mapInArrow(make, "dim int, n long, total array<string>")
    cells = parts.select("dim", "n", F.posexplode("total").alias("at", "value")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    got = materialise(cells, "sums")
    best = got.where("at = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return 0, 0, np.zeros(0, dtype=object)
    rows = got.where(F.col("dim") == best.dim).orderBy("at").collect()  # a row a dimension
    return int(best.n), best.dim, np.array([int(r.value) for r in rows], dtype=object)


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", " ".join(map(str, x.ravel())).encode()
    for kind in ("i2", "i4", "i8"):
        if x.dtype.kind == "f" or np.abs(x).max(initial=0) <= np.iinfo(kind).max:
            break
    kind = "f8" if x.dtype.kind == "f" else kind
    return kind, x.astype("<" + kind).tobytes()


def _wide(kind: str, raw: bytes, width: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in raw.split()], dtype=object).reshape(-1, width)
    x = np.frombuffer(raw, "<" + kind).reshape(-1, width)
    return x if kind == "f8" else x.astype(np.int64)


def tiled_covariance(vectors: DataFrame, dim: int, n: int, entries, centre, tile: int = TILE, block_rows: int = ROWS) -> np.ndarray:
    """Covariance, divisor n, of the vectors that entries(batch) gives as a matrix; centre(columns, x) centres a block."""
    import pyarrow as pa
    from pyspark import TaskContext

    blocks = -(-dim // tile)
    cut = pa.schema([("rows", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("block", pa.binary())])

    def columns(part: int) -> slice:
        return slice(part * tile, min(dim, (part + 1) * tile))

    def column_blocks(batches):
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            x = entries(b)
            for at in range(0, len(x), block_rows):
                held.append(x[at : at + block_rows])
                size += len(held[-1])
                if size >= block_rows:
                    yield from parts(number, held)
                    number, held, size = number + 1, [], 0
        if size:
            yield from parts(number, held)

    def parts(number, held):
        x = np.concatenate(held)
        for part in range(blocks):
            kind, raw = _narrow(x[:, columns(part)])
            yield pa.RecordBatch.from_pydict({"rows": [number], "part": [part], "kind": [kind], "block": [raw]}, schema=cut)

    summed = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.binary())])

    def products(batches):
        """Sorted by tile and row block, the lower column block first; one sum a tile goes out."""
        at, total, left = None, None, None
        for i, j, rows, part, kind, raw in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if at != (i, j):
                if at:
                    yield result(at, total)
                at, total = (i, j), 0.0
            x = centre(columns(part), _wide(kind, raw, columns(part).stop - columns(part).start))
            if part == i:
                left = x
            if part == j:
                total = total + left.T @ x
        if at:
            yield result(at, total)

    def result(at, total):
        return pa.RecordBatch.from_pydict({"i": [at[0]], "j": [at[1]], "total": [np.ascontiguousarray(total).tobytes()]}, schema=summed)

    def add(key, t):
        total = sum(np.frombuffer(x) for x in sorted(t["total"].to_pylist()))
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    made = vectors.mapInArrow(column_blocks, "rows long, part int, kind string, block binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = made.select("*", other.alias("other")).select(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rows", "part", "kind", "block")
    dealt = tiles.repartition("i", "j", F.pmod(F.xxhash64("rows"), F.lit(SPREAD))).sortWithinPartitions("i", "j", "rows", "part")
    # a sum a tile and task; the result is as large as the matrix
    sums = dealt.mapInArrow(products, "i int, j int, total binary").groupBy("i", "j").applyInArrow(add, "i int, j int, total binary").collect()
    out = np.zeros((dim, dim))
    for r in sums:
        a, b = columns(r.i), columns(r.j)
        x = np.frombuffer(r.total).reshape(a.stop - a.start, -1) / n
        out[a, b], out[b, a] = x, x.T
    return (out + out.T) / 2


def fit(vectors: DataFrame, tile: int = TILE, block_rows: int = ROWS) -> Fit:
    """Eigenvectors and eigenvalues of the covariance of all usable vectors, by falling eigenvalue."""
    n, dim, total = sums(vectors)
    if not n:
        return Fit(0, 0, total, np.zeros((0, 0)), np.zeros(0), 0.0)

    def entries(batch):
        return whole_numbers(_matrix(batch, dim)[dim][1])

    def centre(cols, x):
        return deviations(x, n, total[cols]).astype(float) / n

    v = tiled_covariance(vectors, dim, n, entries, centre, tile, block_rows)
    values, axes = np.linalg.eigh(v)
    return Fit(n, dim, total, np.ascontiguousarray(axes[:, ::-1]), values[::-1].copy(), float(np.trace(v)))


def project(vectors: DataFrame, fitted: Fit, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of the usable vectors; NaN where a component has no variance."""
    import pyarrow as pa

    k = min(most, fitted.dim)
    scale = np.where(fitted.defined()[:k], 1 / np.sqrt(np.where(fitted.defined()[:k], fitted.values[:k], 1)), np.nan)
    n, dim, total, axes = fitted.n, fitted.dim, fitted.total, fitted.vectors[:, :k] * scale
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def make(batches):
        for b in batches:
            ids, c = _matrix(b, dim)[dim]
            d = deviations(whole_numbers(c), n, total)
            w = (d.astype(float) / n) @ axes
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(squared_lengths(d), pa.int64()), lists], schema=schema)

    return vectors.mapInArrow(make, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int, defined: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened rows, minus the identity."""
    cells = whitened.select(F.posexplode("whitened").alias("at", "value")).groupBy("at").agg((F.sum("value") / n).alias("mean"))
    mean = np.zeros(k)
    for r in cells.collect():  # a row a component
        mean[r.at] = r.mean

    def entries(batch):
        return batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    v = tiled_covariance(whitened, k, n, entries, lambda cols, x: x - mean[cols], tile=TILE // 2)
    rest = (v - np.eye(k))[np.ix_(defined, defined)]
    return float(np.abs(rest).max(initial=0.0))


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding) to a row for each usable vector and component."""
    rows = _usable(vectors)
    fitted = fit(rows)
    k = min(most, fitted.dim)
    if not fitted.n:
        return rows.where(F.lit(False)).selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    done = materialise(project(rows, fitted, most), "whitened")
    error = identity_error(done.select("whitened"), fitted.n, k, fitted.defined()[:k])
    share = F.array(*[F.lit(float(e) / fitted.trace if fitted.trace > 0 else None).cast("double") for e in fitted.values[:k]])
    out = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all vectors of embeddings on their first 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
