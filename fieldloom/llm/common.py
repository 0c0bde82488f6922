"""Shared helpers of the corpus operators: scratch space, connected components, text rules."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir or setCheckpointDir(); a folder of our own only on a local master.

    Each run's tables lie in <folder>/fieldloom and are no longer needed once its result is written: clear that folder
    between runs.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(context, "_fieldloom_scratch", None)
    if own is None:
        own = context._fieldloom_scratch = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/fieldloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._fieldloom_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_rows(df: DataFrame, make, schema: str, batch_rows: int = 256, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Run make(iterator of row dicts) -> iterator of row dicts on each partition, through Arrow.

    Spark bounds an Arrow batch by rows and by bytes; of it, batch_rows rows at a time become Python objects, and as many
    make an output batch. The columns named in arrays, lists of numbers without nulls, come as numpy arrays.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rows, size = [], 0
        for row in make(r for b in batches for at in range(0, b.num_rows, batch_rows) for r in _rows(b.slice(at, batch_rows))):
            rows.append(row)
            size += 1
            if size >= batch_rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    def _rows(batch):
        names = batch.schema.names
        cols = [_arrays(c) if name in arrays else c.to_pylist() for name, c in zip(names, batch.columns, strict=True)]
        for values in zip(*cols, strict=True):
            yield dict(zip(names, values, strict=True))

    def _arrays(column):
        flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [flat[a:b] if known else None for a, b, known in zip(at, at[1:], column.is_valid().to_pylist())]

    return df.mapInArrow(run, schema)


def nested(df: DataFrame) -> Column:
    """All columns of df as one struct, so that columns beside it can have any name."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def numbered(df: DataFrame, label: str, **more: Column) -> DataFrame:
    """df as (n, row, ...): a number for each row and the row itself, and the columns of more; written, so that numbers stay."""
    return materialise(df.select(F.monotonically_increasing_id().alias("n"), nested(df).alias("row"), *[c.alias(k) for k, c in more.items()]), label)


#: Numbers of a page: the bits of one of Spark's bitmaps.
PAGE = 1 << 15


def _page(number: str) -> Column:
    return F.shiftright(number, 15)


def pages(df: DataFrame, label: str, **marks: Column) -> DataFrame:
    """(page, ...) of the numbers in column n of df: for each page and mark, a bitmap of the numbers for which it is true; written.

    A bit a number, so that Spark broadcasts it beside rows whose numbers alone would have the rows shuffled. Numbers are dealt
    out by page first: a page's bitmaps would else leave each task that holds one of its numbers.
    """
    bit = F.col("n").bitwiseAND(F.lit(PAGE - 1))
    dealt = df.withColumn("page", _page("n")).repartition("page")
    return materialise(dealt.groupBy("page").agg(*[F.bitmap_construct_agg(F.when(c, bit)).alias(k) for k, c in marks.items()]), label)


def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (n, ...) of the pages found, with their marks as booleans."""
    bit = F.col("n").bitwiseAND(F.lit(PAGE - 1)).cast("int")
    marks = [k for k in found.columns if k != "page"]
    byte = {k: F.conv(F.hex(F.substring(F.col(k), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int") for k in marks}
    both = rows.withColumn("page", _page("n")).join(found, "page")
    return both.select(*rows.columns, *[(F.getbit(byte[k], bit.bitwiseAND(F.lit(7))) == 1).alias(k) for k in marks])


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of the undirected edges (a long, b long).

    Returns (id, component_id) with a row for each node that has an edge to another node. Alternates
    the large-star and small-star steps; every round is a handful of hash aggregations and joins over
    at most as many edges as it was given, and is written to the shared folder, so no node's
    neighbours meet in one task's memory and a lost executor costs one round at most.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"
    )
    seen = _digest(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.select("u", F.col("m").alias("v")).unionByName(linked).where("u > v").distinct(), "edges")
        digest = _digest(after)
        discard(now)
        now = after
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
    return tuple(row)


def np_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, for the edges (u[i], v[i])."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        apart = label[u] != label[v]
        if not apart.any():
            break
        u, v = u[apart], v[apart]
    return label
