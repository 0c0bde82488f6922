"""Documents find their forms without a shared key: by alike names and equal dates of birth.

Names are compared as sets of two-letter grams of their sorted tokens, by Jaccard similarity. The join is exact: two sets of
similarity t or more share one of their first |x| - ceil(t |x|) + 1 grams in any common order, so only these prefixes are
joined, rarest grams first, and only where what follows a gram in either set can reach t. A pair is compared in full at each
gram it shares there, and kept at the first. The date of birth is part of the join's key, so names that never share a day are
not compared. A name is compared once a day, however many people have it then. A gram with over HOT names of a day on the left
is dealt over several keys, and the right side's names for it go to each of them.

The order of grams is a table of CELLS small numbers, a copy of which stands beside each name for a moment: grams are counted
by cells, of which each pair of small Latin letters has its own. That table and the grams over HOT, a row for HOT names at
least, are all that is broadcast: every other join is a merge join by hint, as Spark's estimates know neither how many grams a
name has nor how large a checkpoint is.

Normal forms are read several times: they are written to the folder of spark.checkpoint.dir (or setCheckpointDir()), or kept
by the executors without one, and the plans of what reads them begin there. Nested in one another, as cached tables are, they
fill the driver's memory with descriptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.pytext import once, tokens
from . import score

LEAST = 0.6
#: Names on the left that share a gram and a key.
HOT = 4096
#: Cells in which grams are counted, by the last six bits of either character.
CELLS = 1 << 12
#: Bits of a code point.
_BITS = 21


def grams(name: Column) -> Column:
    """Distinct two-letter grams, as numbers, of a name's sorted tokens with a space at either end; none of an empty name."""
    line = F.concat(F.lit(" "), F.array_join(F.array_sort(tokens(name)), " "), F.lit(" "))
    codes = F.transform(F.split(line, ""), lambda c: F.ascii(c).cast("long"))
    cut = once(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda p, q: F.shiftleft(p, _BITS) + q))
    return F.when(F.trim(name) == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(cut))


def _cell(gram: Column) -> Column:
    return (F.shiftright(gram, _BITS) % 64 * 64 + gram % 64).cast("int")


def _places(names: DataFrame) -> DataFrame:
    """One row (places): of each cell its place by the number of names that have a gram there, rarest first."""
    # each has a gram; before an explode that is not outer, Spark computes the array once more, to filter empty ones
    counted = names.select(F.explode_outer("grams").alias("gram")).groupBy(_cell(F.col("gram")).alias("cell")).count()
    count = {r["cell"]: r["count"] for r in counted.collect()}
    places = [0] * CELLS
    for place, cell in enumerate(sorted(count, key=lambda c: (count[c], c))):
        places[cell] = place
    return names.sparkSession.createDataFrame([(places,)], "places array<smallint>")


def alike_names(left: DataFrame, right: DataFrame, least: float = LEAST, hot: int = HOT, on: tuple[str, ...] = ()) -> DataFrame:
    """(name, other, *on, jaccard): the pairs of a left and a right name with a similarity of `least` or more; each side has a column name.

    With columns `on`, which both sides have, names are paired only where those are equal, too.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity is over 0 and 1 at most")
    a, b = (rows.select("name", *on).where(F.trim("name") != "").distinct().select("name", *on, grams(F.col("name")).alias("grams")) for rows in (left, right))
    places = F.broadcast(_places(a.unionByName(b)))

    def entries(names: DataFrame) -> DataFrame:
        """A row for each gram of a name's prefix; a gram's number begins with its place, so numbers in order are grams in order."""
        placed = F.sort_array(F.transform("grams", lambda g: F.shiftleft(F.get("places", _cell(g)).cast("bigint"), 2 * _BITS) + g))
        size = F.size("grams")
        prefix = F.slice("grams", F.lit(1), size - F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int") + 1)
        return names.crossJoin(places).select("name", *on, placed.alias("grams")).select("name", *on, "grams", F.posexplode_outer(prefix).alias("place", "gram"))

    x, y, at = entries(a), entries(b), [*on, "gram"]
    keys = F.broadcast(x.groupBy(*at).agg(F.ceil(F.count("*") / hot).cast("int").alias("keys")).where("keys > 1"))
    n = F.coalesce("keys", F.lit(1))
    x = x.join(keys, at, "left").select("name", "grams", "place", *at, F.pmod(F.xxhash64("name"), n).cast("int").alias("part"))
    y = y.join(keys, at, "left").select(F.col("name").alias("other"), F.col("grams").alias("o_grams"), F.col("place").alias("o_place"), *at, F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))

    def similarity(shared: Column) -> Column:
        return shared / (F.size("grams") + F.size("o_grams") - shared)

    # of a pair's first gram in common, no other one stands before it on either side
    reach = similarity(F.least(F.size("grams") - F.col("place"), F.size("o_grams") - F.col("o_place"))) >= least - 1e-9
    pairs = x.join(y.hint("merge"), [*at, "part"]).where(reach)
    # generated, so that Spark does not compute it anew for each use
    pairs = pairs.select("name", "other", *on, "gram", "grams", "o_grams", F.explode(F.array(F.array_intersect("grams", "o_grams"))).alias("shared"))
    first = pairs.where(F.get("shared", F.lit(0)) == F.col("gram"))
    return first.select("name", "other", *on, similarity(F.size("shared")).alias("jaccard")).where(F.col("jaccard") >= least - 1e-9)


def _cut(rows: DataFrame) -> DataFrame:
    """The same rows, computed once, with a plan that begins there."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def linked(documents: DataFrame, forms: DataFrame, least: float = LEAST, score_least: float | None = None, hot: int = HOT) -> DataFrame:
    """(doc_key, form_key, jaccard, name_score) of documents (doc_key, name, dob) and forms (form_key, name, dob).

    Names are alike in their normal form and days of birth equal, once read; with score_least, name_score must reach it, too.
    Rows without a name or a readable date link with nothing; equal keys are rows of their own.
    """

    def normal(rows: DataFrame, key: str) -> DataFrame:
        latin = rows.select(key, N.to_latin(F.coalesce("name", F.lit(""))).alias("latin"), F.coalesce(F.col("dob").cast("string"), F.lit("")).alias("dob"))
        return latin.select(key, N.generic(F.col("latin")).alias("name"), N.loose_date(F.col("dob"))["ymd"].alias("born"))

    # filtered after the cut: Spark takes a filter before a shuffle, and there reads the names of a small file in few tasks, twice
    docs, given = (_cut(rows).where("name <> '' and born <> ''") for rows in (normal(documents, "doc_key"), normal(forms, "form_key")))
    scored = alike_names(docs, given, least, hot, on=("born",)).withColumn("name_score", score.name_score(F.col("name"), F.col("other")))
    if score_least is not None:
        scored = scored.where(F.col("name_score") >= score_least)
    found = docs.join(scored.hint("merge"), ["name", "born"]).join(given.select("form_key", F.col("name").alias("other"), "born").hint("merge"), ["other", "born"])
    return found.select("doc_key", "form_key", "jaccard", "name_score")
