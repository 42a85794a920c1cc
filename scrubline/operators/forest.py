"""Isolation forest: rows that random cuts separate quickly are flagged.

Trees need only a few hundred rows each. Which ones is decided by hashes of the rows, so the draw is
the same however the table is partitioned; each tree grows in a task of its own. Scoring is a
vectorised UDF over all rows and ships the trees, whose size is bounded by trees x sample, not by the
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.columns import OUTLIER_FLAG, as_double, measure_columns
from scrubline.operators.quantiles import exact_quantiles
from scrubline.storage import write_table

COPIES = 4096  # equal rows are numbered in runs of this many
_EULER = 0.5772156649015329


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    n = np.asarray(n, dtype="float64")
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + _EULER) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> np.ndarray:
    """One random tree as rows (feature, cut, left, right, path length); feature -1 is a leaf."""
    nodes: list[list[float]] = []
    todo = [(np.arange(len(points)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = here
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(open_features):
            nodes.append([-1, 0.0, here, here, depth + float(mean_path(len(rows)))])
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:
            cut = float(low[f])
        goes_left = points[rows, f] <= cut
        nodes.append([f, cut, here, here, 0.0])
        todo.append((rows[~goes_left], depth + 1, here, 1))
        todo.append((rows[goes_left], depth + 1, here, 0))
    return np.array(nodes)


def path_lengths(points: np.ndarray, trees: list[np.ndarray], max_depth: int) -> np.ndarray:
    """Mean path length of every point over all trees."""
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for tree in trees:
        feature, cut = tree[:, 0].astype("int64"), tree[:, 1]
        left, right = tree[:, 2].astype("int64"), tree[:, 3].astype("int64")
        at = np.zeros(len(points), dtype="int64")
        for _ in range(max_depth):
            # Leaves point to themselves on both sides.
            at = np.where(points[rows, feature[at]] <= cut[at], left[at], right[at])
        total += tree[at, 4]
    return total / len(trees)


@dataclass
class ForestFit:
    columns: list[str]
    trees: list[np.ndarray]
    sample: int
    depth: int
    threshold: float | None = None


def _complete(df: DataFrame, cols: list[str]):
    test = F.lit(True)
    for c in cols:
        test = test & as_double(df, c).isNotNull()
    return test


def fit_forest(
    df: DataFrame,
    cols: Iterable[str] | None = None,
    contamination: float = 0.02,
    seed: int = 42,
    n_trees: int = 100,
    max_samples: int = 256,
) -> ForestFit | None:
    """The trees and the threshold; none for a table without complete rows or measures."""
    names = measure_columns(df, cols)
    if not names:
        return None
    points = df.where(_complete(df, names)).select(
        *[as_double(df, c).alias(f"c{i}") for i, c in enumerate(names)]
    )
    n = points.count()
    if n == 0:
        return None
    sample = min(max_samples, n)
    depth = math.ceil(math.log2(max(sample, 2)))
    drawn = draw_samples(points, n, n_trees, max_samples, seed)
    order = ["__hash__", *points.columns, "__copy__"]

    def grow(key, pdf):
        rng = np.random.default_rng([seed, int(key[0])])
        rows = pdf.sort_values(order)[points_columns].to_numpy("float64")[:sample]
        return pd.DataFrame({"tree": [key[0]], "nodes": [grow_tree(rows, rng, depth).ravel()]})

    points_columns = points.columns
    grown = drawn.groupBy("tree").applyInPandas(grow, "tree long, nodes array<double>")
    # As many nodes as trees x sample at most.
    trees = [np.array(r["nodes"]).reshape(-1, 5) for r in sorted(grown.collect(), key=lambda r: r["tree"])]
    fit = ForestFit(names, trees, sample, depth)
    # The threshold needs every score, but only the scores: the table itself is not stored again.
    scored = write_table(score_rows(df, fit).select("__score__"), "forest-scores")
    [threshold] = exact_quantiles(scored, {"s": F.col("__score__")}, [1.0 - contamination])["s"]
    fit.threshold = threshold
    return fit


def draw_samples(points: DataFrame, n: int, n_trees: int, max_samples: int, seed: int) -> DataFrame:
    """(tree, __hash__, columns of ``points``, __copy__): the rows each tree may grow from.

    A row goes to the trees for which its hash is small; somewhat more than ``max_samples`` rows do, and
    a tree takes those with the smallest. Equal rows are numbered to have hashes of their own: they are
    counted first and dealt out in runs, so that no task holds all copies of a common row.
    """
    share = (max_samples + 10.0 * math.sqrt(max_samples)) / n
    limit = min(int(share * 2.0**64), 2**64 - 1) - 2**63
    counted = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__n__"))
    runs = counted.withColumn("__run__", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("__n__") - 1) / COPIES)
    ))).repartition(*points.columns, "__run__")
    first = F.col("__run__") * COPIES
    numbered = runs.withColumn("__copy__", F.explode(F.sequence(first, F.least(first + COPIES, "__n__") - 1)))
    chance = lambda t: F.xxhash64(F.lit(seed), t, *points.columns, "__copy__")
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: chance(t) <= F.lit(limit))
    return numbered.withColumn("tree", F.explode(trees)).select(
        F.col("tree").cast("long").alias("tree"), chance(F.col("tree")).alias("__hash__"), *points.columns, "__copy__"
    )


def score_rows(df: DataFrame, fit: ForestFit) -> DataFrame:
    """Anomaly score in (0, 1] as ``__score__``, NULL for incomplete rows."""
    trees, depth = fit.trees, fit.depth
    scale = float(mean_path(fit.sample)) or 1.0

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        points = np.column_stack([s.to_numpy(dtype="float64", na_value=np.nan) for s in series])
        out = np.full(len(points), np.nan)
        full = ~np.isnan(points).any(axis=1)
        if full.any():
            out[full] = np.exp2(-path_lengths(points[full], trees, depth) / scale)
        return pd.Series(out)

    raw = score(*[as_double(df, c) for c in fit.columns])
    return df.withColumn("__score__", raw).withColumn("__score__", F.nanvl("__score__", F.lit(None)))


def apply_forest(df: DataFrame, fit: ForestFit | None) -> DataFrame:
    """Flag rows of another table by fitted trees and threshold."""
    if fit is None:
        return df.withColumn(OUTLIER_FLAG, F.lit(False))
    flag = F.coalesce(F.col("__score__") > fit.threshold, F.lit(False))
    return score_rows(df, fit).withColumn(OUTLIER_FLAG, flag).drop("__score__")


def fit_and_flag(df: DataFrame, cols=None, **params) -> tuple[DataFrame, ForestFit | None]:
    df = df.drop(OUTLIER_FLAG)
    fit = fit_forest(df, cols, **params)
    return apply_forest(df, fit), fit


def flag_outliers_isolation_forest(
    df: DataFrame,
    cols: Iterable[str] | None = None,
    contamination: float = 0.02,
    seed: int = 42,
    n_trees: int = 100,
    max_samples: int = 256,
) -> DataFrame:
    """Add ``__is_outlier__``: the given share of complete rows that are easiest to isolate.

    Incomplete rows, and all rows of a table without measures, are not flagged. The same seed flags
    the same rows, however they are partitioned or ordered.
    """
    return fit_and_flag(
        df, cols, contamination=contamination, seed=seed, n_trees=n_trees, max_samples=max_samples
    )[0]
