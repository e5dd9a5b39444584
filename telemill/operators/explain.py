"""Exact Shapley values of tree ensembles, where absent features follow the training rows' shares at each split.

A leaf's path has, for each of its d features, the share z of training rows that take its turns, and whether a row takes
them (o, 0 or 1).  A feature's value from that leaf is the leaf's value times (o - z) times the average, over all orders
in which features may become known, of the product of the others' o (known) or z (not yet).  That average is the
integral over t from 0 to 1 of the product of (1 - t) z + t o of the other features: a polynomial of degree d - 1, which
Gauss's rule with d / 2 points gives exactly.  All factors are positive, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import sensor_category
from .trees import Ensemble, Tree

#: Features of a path up to which all combinations of taken turns are worked out beforehand.
TABLE = 10


@dataclass
class Path:
    """A leaf: its value, and for each feature its turns (node, left) and the share of training rows that take them."""

    value: float
    features: list[int]
    turns: list[list[tuple[int, bool]]]
    share: np.ndarray


def paths(tree: Tree) -> Iterator[Path]:
    todo: list[tuple[int, dict[int, tuple[list[tuple[int, bool]], float]]]] = [(0, {})]
    while todo:
        node, seen = todo.pop()
        if tree.left[node] < 0:
            yield Path(float(tree.value[node]), list(seen), [t for t, _ in seen.values()], np.array([z for _, z in seen.values()]))
            continue
        f = int(tree.feature[node])
        turns, z = seen.get(f, ([], 1.0))
        for child, left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            todo.append((child, {**seen, f: ([*turns, (node, left)], z * tree.cover[child] / tree.cover[node])}))


def contributions(path: Path, taken: np.ndarray) -> np.ndarray:
    """What the leaf gives to each feature of its path, for rows of ``taken`` turns (0 or 1 for each feature)."""
    d = len(path.features)
    points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
    out = np.zeros(taken.shape)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        factors = (1 - t) * path.share + t * taken
        out += w * factors.prod(axis=1, keepdims=True) / factors
    return path.value * (taken - path.share) * out


def shapley(model: Ensemble, bins: np.ndarray) -> np.ndarray:
    """Shapley values: a row for each of ``bins``' columns, a column for each feature."""
    out = np.zeros((bins.shape[1], len(model.features)))
    for tree in model.trees:
        left = {k: tree.goes_left(bins, k) for k in np.flatnonzero(tree.left >= 0).tolist()}
        for path in paths(tree):
            d = len(path.features)
            if not d:
                continue
            pattern = np.zeros(bins.shape[1], dtype=np.int64)
            for j, turns in enumerate(path.turns):
                ok = np.ones(bins.shape[1], dtype=bool)
                for node, way in turns:
                    ok &= left[node] if way else ~left[node]
                pattern |= ok.astype(np.int64) << j
            known, where = (np.arange(1 << d), pattern) if d <= TABLE else np.unique(pattern, return_inverse=True)
            table = contributions(path, ((known[:, None] >> np.arange(d)) & 1).astype(np.float64))
            out[:, path.features] += table[where]
    return out


def expected(model: Ensemble) -> float:
    """The prediction when no feature is known: the mean over training rows as the splits' covers tell it."""
    leaves = [(t.value[t.left < 0], t.cover[t.left < 0], t.cover[0]) for t in model.trees]
    return model.base + sum(float((v * c).sum() / n) for v, c, n in leaves)


def values(model: Ensemble) -> Column:
    """A struct of the Shapley values of a row's features, f0, f1 and so on in the model's order."""
    names = [f"f{k}" for k in range(len(model.features))]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def explain(*columns: pd.Series) -> pd.DataFrame:
        bins = model.binned([c.to_numpy(dtype=np.float64) for c in columns])
        return pd.DataFrame(shapley(model, bins), columns=names)

    return explain(*[F.col(c).cast("double") for c in model.features])


def importance(model: Ensemble, df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, feature, category, mean_abs, rank): mean absolute Shapley value of each feature over all rows of a group."""
    explained = df.select(*by, values(model).alias("s"))
    wide = explained.groupBy(*by).agg(*[F.avg(F.abs(f"s.f{k}")).alias(f"m{k}") for k in range(len(model.features))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{k}").alias("mean_abs")) for k, f in enumerate(model.features)])
    long = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.feature", sensor_category(F.col("r.feature")).alias("category"), "r.mean_abs")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")))
