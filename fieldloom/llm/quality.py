"""Quality classifier: a sparse ensemble of rules over text statistics, scored by Spark columns.

Shallow trees are grown by gradient boosting on a bounded sample of labelled rows; each path from a
root is a conjunction of comparisons. A lasso logistic regression (accelerated proximal gradient, all
in numpy) gives the conjunctions weights, most of them zero. What is left is compiled into one Spark
column expression over the statistics, which one pass of an Arrow UDF takes from each whole text.

Defined cases: null texts count as empty; empty texts get the score of all-zero statistics; a null id
is never held out; rows that share an id are scored each by itself; a doc_id labelled more than once has its mean label, rounded up from one half;
labels other than 0 and 1 and null labels are not learnt from; without any usable label every score is
0.5, with one class only it is that class's smoothed share; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import nested, table

#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 20_000

STATISTICS = (
    "chars", "words", "chars_per_word", "upper_share", "symbol_share", "pipe_share", "bang_share", "digit_share",
    "stop_share", "distinct_root", "repeat_share", "short_share", "line_repeat", "words_per_line",
)
_UPPER, _SYMBOLS, _BANGS, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*<>{}=~^@\\_[]+/", b"!?", b"0123456789", b".,;:"


def measure(text: str | None) -> tuple[float, ...]:
    """STATISTICS of a text; shares are of characters or words, 0 for empty texts. Letters and marks counted are ASCII."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words, lines = t.split(), [x for x in t.split("\n") if x]
    c, n, k = max(1, len(t)), max(1, len(words)), max(1, len(lines))

    def hits(marks: bytes) -> int:
        return len(raw) - len(raw.translate(None, marks))

    return (
        float(len(t)), float(len(words)), len(t) / n if words else 0.0, hits(_UPPER) / c, hits(_SYMBOLS) / c, raw.count(b"|") / c, hits(_BANGS) / c, hits(_DIGITS) / c,
        hits(_STOPS) / n, len(set(words)) / (2 * n) ** 0.5, sum(map(eq, words, islice(words, 1, None))) / n, sum(map((3).__ge__, map(len, words))) / n,
        (len(lines) - len(set(lines))) / k, len(words) / k,
    )


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in STATISTICS]))
def _statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(STATISTICS), dtype=float)


#: Evaluated once a row, whatever filters and projections the optimiser would like to move.
statistics = _statistics.asNondeterministic()


@dataclass(frozen=True)
class Rule:
    """weight if every (statistic, above, threshold) holds."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, at: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, threshold in rule.terms:
                holds = holds & ((at[name] > threshold) if above else (at[name] <= threshold))
            total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _best_split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """Largest gain in squared error over columns of x and up to 32 thresholds each."""
    best, total, n = None, g.sum(), len(g)
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 48), method="nearest"))
        where = np.searchsorted(cuts, x[:, j], side="left")
        count = np.cumsum(np.bincount(where, minlength=len(cuts) + 1))[:-1]
        left = np.cumsum(np.bincount(where, weights=g, minlength=len(cuts) + 1))[:-1]
        ok = (count >= least) & (n - count >= least)
        if not ok.any():
            continue
        c, s = count[ok], left[ok]
        gain = s**2 / c + (total - s) ** 2 / (n - c)
        at = int(gain.argmax())
        if best is None or gain[at] > best[0]:
            best = (float(gain[at]), j, float(cuts[ok][at]))
    if best is None or best[0] <= total**2 / n + 1e-9:
        return None
    return best


def _grow(x, g, h, rows, depth, least, path, paths, out):
    """One tree: appends every path below the root to paths, adds leaf steps to out."""
    split = _best_split(x[rows], g[rows], least) if depth else None
    if split is None:
        out[rows] += g[rows].sum() / (h[rows].sum() + 1.0)
        return
    _, j, cut = split
    low = x[rows, j] <= cut
    for side, above in ((rows[low], False), (rows[~low], True)):
        step = (*path, (j, above, cut))
        paths.append(step)
        _grow(x, g, h, side, depth - 1, least, step, paths, out)


def _paths(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3) -> list[tuple]:
    rng, paths, f = np.random.default_rng(7), [], np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), size=max(1, len(y) * 3 // 4), replace=False))
        _grow(x, y - p, p * (1 - p), rows, depth, max(5, len(y) // 200), (), paths, step)
        f = f + 0.3 * step
    return paths


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, cut in path:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic loss plus penalty times the absolute weights; the bias goes free."""
    n = len(y)
    step = 4.0 / (np.linalg.norm(np.c_[np.ones(n), r], 2) ** 2 / n)
    w = z = np.zeros(r.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z[0] + r @ z[1:])))
        grad = np.r_[(p - y).mean(), r.T @ (p - y) / n]
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, penalty: float = 2e-3) -> Ensemble:
    """Rules from trees over the columns of x (names), weighted for labels y in {0, 1}."""
    if not len(y):
        return Ensemble(0.0, ())
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return Ensemble(float(np.log(share / (1 - share))), ())
    seen: dict[bytes, tuple] = {}
    for path in sorted(_paths(x, y), key=len):
        holds = _holds(x, path)
        seen.setdefault(min(holds.tobytes(), (~holds).tobytes()), path)
    paths = list(seen.values())
    r = np.stack([_holds(x, p) for p in paths], 1).astype(float)
    bias, w = _lasso(r, y.astype(float), penalty)
    kept = [(p, c) for p, c in zip(paths, w, strict=True) if abs(c) > 1e-6]
    return Ensemble(bias, tuple(Rule(tuple((names[j], above, cut) for j, above, cut in p), float(c)) for p, c in kept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """Fit on the FIT_ROWS labelled, not held-out rows with the smallest id hashes."""
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("fit_id"))
        .agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("fit_label"))
        .orderBy(F.xxhash64("fit_id"), "fit_id")
        .limit(FIT_ROWS)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), F.col("doc_id") == F.col("fit_id"))  # FIT_ROWS rows at most
    stats = rows.select("fit_id", "fit_label", F.xxhash64("text").alias("fit_tie"), statistics("text").alias("stats"))
    got = stats.orderBy(F.xxhash64("fit_id"), "fit_id", "fit_tie").limit(FIT_ROWS).select("fit_label", "stats.*").toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(float), got["fit_label"].to_numpy())


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(row, score): the rows of docs, with all their columns, and their scores."""
    wide = docs.select(nested(docs).alias("row"), statistics("text").alias("stats"))
    return wide.select("row", model.score({k: F.col("stats")[k] for k in STATISTICS}).alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, with all their columns, without the rows that the classifier rejects."""
    every = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(every, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).where("score >= 0.5").select("row.*")
