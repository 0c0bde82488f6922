"""Mixing sources to target weights by weighted sampling without replacement.

Every row gets an exponential key -ln(u) / w, u in (0, 1) from a hash of its id and w its quality
weight (Efraimidis and Spirakis): the rows of a source in ascending key order are a weighted sample
of any length. A source's target is taken as complete epochs of all its rows, then as a fraction of
one more epoch: rows in key order, their sizes summed, up to the rest of the target.

The sum in key order never brings a source into one task. A row's key falls into one of BINS bins by
a fixed monotone map; sums of bins (aggregated before the shuffle) say which bins lie wholly inside
or outside the budget, and only the one bin of each source that the budget cuts is ordered by rows.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
ordered last; repeated rows count each for itself, ties in key are ordered by id, size and text hash;
an empty table gives an empty result; extra columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import marked, materialise, numbered, pages, table, word_count

BINS = 1 << 16
#: No source is repeated more often than this.
MOST_EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """In [0.5, 1.5]: 0.5 plus the share of a text that is not ASCII punctuation or digits; 0.5 for null and empty."""
    plain = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.coalesce(F.lit(0.5) + F.try_divide(plain, F.length(text)), F.lit(0.5))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target), all sources in code-point order, null last.

    Weights are 1, 2, 3, repeating. What a source cannot take of its share (over 3 times its size) is
    shared out again by weight; the sources that end at their cap are those with the smallest caps for
    their weight, so one sorted pass finds them. One row a source: an aggregate of the table.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    one = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = one.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    return (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * MOST_EPOCHS)
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # capped if the share left to this and the later sources would lift it above its cap
        .withColumn("capped", (F.col("all_size") - F.col("cap_before")) * F.col("weight") > F.col("cap") * (F.col("all_weight") - F.col("weight_before")))
        .withColumn("capped", F.min(F.col("capped").cast("int")).over(one.rowsBetween(W.unboundedPreceding, 0)) == 1)
        .withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("weight_sum", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0)))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
                (F.col("all_size") - F.col("cap_sum")) * F.col("weight") / F.col("weight_sum").cast("double")
            ),
        )
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, number: str | None = None) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, size, source, source_size, target, quality_weight, taken).

    number names a long column of docs that comes along.

    taken counts the words that the mix takes of a row, repeats counted: epochs * size, and in the last,
    fractional epoch the whole row before the budget ends, the row's first words where it ends, or nothing.
    The words taken of a source are its target rounded to whole words. No row is taken over MOST_EPOCHS times.
    """
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 13)
    unit = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality_weight"), F.xxhash64("text").alias("tie"), (F.col(number) if number else F.lit(None).cast("long")).alias("number"))
    rows = rows.withColumn("sort_key", -F.log(unit) / F.col("quality_weight"))
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("sort_key"))) * BINS), F.lit(BINS - 1)).cast("int"))
    rows = materialise(rows, "mix")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    goal = goal.withColumn("whole", F.round("target").cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(F.lit(0)).cast("long"))
    goal = materialise(goal.withColumn("budget", F.col("whole") - F.col("epochs") * F.col("source_size")), "goal")
    goal = goal.withColumn("key", F.struct("source"))
    # at most BINS rows a source, whatever the number of rows
    ordered = bins.withColumn("upto", F.sum("bin_size").over(W.partitionBy("source").orderBy("bin")))
    ordered = ordered.withColumn("key", F.struct("source")).drop("source")
    cut = (
        ordered.join(goal.select("key", "budget"), "key")
        .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("bin_size") <= F.col("budget")) & (F.col("bin_size") > 0))
        .select("key", F.col("bin").alias("cut_bin"), (F.col("upto") - F.col("bin_size")).alias("cut_before"))
    )
    # written, so its size is measured: a row a source, which Spark broadcasts if small, and then no source meets in one task
    goal = materialise(goal.join(cut, "key", "left").drop("key"), "cuts").withColumn("key", F.struct("source"))
    rows = rows.withColumn("key", F.struct("source")).drop("source")
    rows = rows.join(goal, "key")
    inside = W.partitionBy("source", "bin").orderBy("sort_key", "doc_id", "size", "tie", "number").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.where("bin = cut_bin").withColumn("rest", F.col("budget") - F.col("cut_before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rest = rows.where("cut_bin is null or bin <> cut_bin").withColumn("rest", F.when(F.col("cut_bin").isNull(), 0).when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(0).cast("long"))
    partly = F.greatest(F.lit(0), F.least("size", "rest"))
    return edge.unionByName(rest).select(
        *(["number"] if number else []), "doc_id", "size", "source", "source_size", "target", "quality_weight", (F.col("epochs") * F.col("size") + partly).cast("long").alias("taken")
    )


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the columns of docs, whatever their names: a row for each whole time that it is taken.

    The row where a budget ends is kept if at least half of it lies inside. A document without words
    adds nothing to any target and stays once. Rows are told apart by a number, not by id, so those that
    share an id or have none are taken each by itself.
    """
    rows = numbered(docs, "rows")
    plan = mix(rows.select("n", "row.doc_id", "row.text", "row.source"), "n")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    copies = plan.select(F.col("number").alias("n"), times.alias("times")).where("times > 0")
    # a mark for each time: no row is taken over MOST_EPOCHS times
    again = {f"again{k}": F.col("times") >= k for k in range(1, MOST_EPOCHS + 1)}
    each = F.filter(F.array(*again), lambda taken: taken)
    return marked(rows, pages(copies, "copies", **again)).select("row", F.explode(each)).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
