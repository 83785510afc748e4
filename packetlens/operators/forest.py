"""Isolation forest (Liu, Ting, Zhou 2008) trained and applied as Spark jobs.

Each tree sees `sample` rows chosen by a content key, so the model depends on the data and the
seed but not on partitioning. Trees are grown in parallel, one group of at most `sample` rows
each; the node table has at most trees * 2 * sample rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import TRAINING_FEATURES
from ..session import shared_dir
from .spread import COPIES, content_key, fold_copies, positions
from .training import cap_rows

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, depth int, size int"
EULER = 0.5772156649015329
MOST_NODES = 10_000_000  # of a model that a task holds


@dataclass(frozen=True)
class IsolationSettings:
    """Fixed default values of the isolation forest."""

    trees: int = 200
    sample: int = 256
    contamination: float = 0.01
    seed: int = 42


@dataclass(frozen=True)
class IsolationModel:
    """Node table, rows per tree, the score below which a row is an anomaly, and the features."""

    nodes: DataFrame
    sample: int
    offset: float
    columns: tuple[str, ...]


def mean_path(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    more = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(more - 1.0) + EULER) - 2.0 * (more - 1.0) / more
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes, todo = [], [(0, np.arange(len(points)), 0)]
    next_id = 1
    while todo:
        node, rows, depth = todo.pop()
        lo, hi = points[rows].min(axis=0), points[rows].max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth >= limit or len(free) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, depth, len(rows)))
            continue
        feature = int(rng.choice(free))
        split = float(rng.uniform(lo[feature], hi[feature]))
        below = points[rows, feature] <= split
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((tree, node, feature, split, left, right, depth, len(rows)))
        todo += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return pd.DataFrame(nodes, columns=names)


def tree_samples(df: DataFrame, settings: IsolationSettings, key: list[str], columns: list[str]) -> DataFrame:
    """`sample` rows per tree, as rows with a `tree` column.

    A uniform pool of at most trees * sample rows is taken from all rows by content key; each tree then takes the
    rows of the pool with its own lowest keys. Trees are drawn alike at every size of the data.
    """
    pool = cap_rows(df, settings.trees * settings.sample, None if key == columns else key, settings.seed)
    every = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))))
    per_tree = every.withColumn("_key", content_key([*key, "tree"], settings.seed))
    order = W.partitionBy("tree").orderBy("_key", *key)
    return per_tree.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= settings.sample).drop("_key", "_n")


def train_isolation_forest(
    df: DataFrame,
    settings: IsolationSettings = IsolationSettings(),
    key: list[str] | None = None,
    columns: list[str] = TRAINING_FEATURES,
) -> IsolationModel:
    """Grow the trees and set the anomaly offset at the contamination quantile of the scores."""
    shared_dir(df.sparkSession)
    key = list(key or columns)
    samples = tree_samples(df.select(*dict.fromkeys([*key, *columns])), settings, key, list(columns))
    seed, names = settings.seed, list(columns)

    def grow(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*names, *key])
        return _grow(rows[names].to_numpy(float), int(group[0]), seed)

    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).checkpoint()
    size = min(settings.sample, df.count())
    model = IsolationModel(nodes, size, 0.0, tuple(names))
    offset = _quantile(df.select(raw_score(model).alias("raw_score")), settings.contamination)
    return IsolationModel(nodes, size, offset, tuple(names))


def _quantile(scores: DataFrame, q: float) -> float:
    """Exact quantile (linear between ranks) of scores in [-1, 0], ranked over many tasks."""
    folded = fold_copies(scores).checkpoint()  # scored once; both steps below read the result
    rank = q * (folded.agg(F.sum(COPIES)).first()[0] - 1) + 1
    low = int(rank)
    block = F.floor(F.col("raw_score") * 1_000_000).cast("bigint")
    ranked = positions(folded, [], block, ["raw_score"], "rank", upto=low + 1, copies=COPIES)
    below, above = (
        ranked.filter(F.col("rank") <= r).agg(F.max_by("raw_score", "rank")).first()[0] for r in (low, low + 1)
    )
    return float(below + (rank - low) * (above - below))


def raw_score(model: IsolationModel) -> Column:
    """Negative anomaly score of the feature columns: near -1 odd, near 0 ordinary.

    The node table is bounded by the settings (trees * 2 * sample rows), so each task may hold it; one of more
    than `MOST_NODES` rows is refused before it is read.
    """
    if model.nodes.count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: use fewer trees or smaller samples")
    table = model.nodes.orderBy("tree", "node").toPandas()
    starts = np.zeros(len(table), dtype=np.int64)
    roots = np.flatnonzero(np.r_[True, table["tree"].to_numpy()[1:] != table["tree"].to_numpy()[:-1]])
    for begin, end in zip(roots, [*roots[1:], len(table)]):
        starts[begin:end] = begin
    feature = table["feature"].to_numpy()
    inner = feature >= 0
    left = np.where(inner, table["left"].to_numpy() + starts, -1)
    right = np.where(inner, table["right"].to_numpy() + starts, -1)
    split = table["split"].to_numpy()
    path = table["depth"].to_numpy() + mean_path(table["size"].to_numpy())
    scale = float(mean_path(model.sample)) or 1.0
    shared = model.nodes.sparkSession.sparkContext.broadcast((feature, split, left, right, path, roots))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        feature, split, left, right, path, roots = shared.value
        points = np.column_stack([c.to_numpy(float) for c in columns])
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for root in roots:
            at = np.full(len(points), root)
            while True:
                which = feature[at]
                moving = np.flatnonzero(which >= 0)
                if len(moving) == 0:
                    break
                here = at[moving]
                below = points[rows[moving], which[moving]] <= split[here]
                at[moving] = np.where(below, left[here], right[here])
            total += path[at]
        return pd.Series(-np.exp2(-total / len(roots) / scale))

    return score(*[F.col(c).cast("double") for c in model.columns])


def score_isolation(df: DataFrame, model: IsolationModel) -> DataFrame:
    """Add `raw_score` and `is_anomaly`."""
    return df.withColumn("raw_score", raw_score(model)).withColumn("is_anomaly", F.col("raw_score") < model.offset)
