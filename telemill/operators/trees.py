"""Regression trees as flat arrays, over binned features that may be missing."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bin of missing values; others are counted from 0.
MISSING = 255
SLOTS = MISSING + 1


@dataclass
class Tree:
    """Node k splits where ``left[k] >= 0``: bins up to ``bin[k]`` go left, missing values as ``missing_left[k]`` says.

    ``value`` is what a row that ends there gets; ``cover`` is the number of training rows that came by.
    """

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Tree:
        columns = list(zip(*rows, strict=True))
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, np.float64, np.int64)
        return cls(*[np.array(c, dtype=k) for c, k in zip(columns, kinds, strict=True)])

    def goes_left(self, bins: np.ndarray, node: int) -> np.ndarray:
        b = bins[self.feature[node]]
        return np.where(b == MISSING, self.missing_left[node], b <= self.bin[node])

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row ends; ``bins`` has a row for each feature."""
        n, at = bins.shape[1], np.zeros(bins.shape[1], dtype=np.int64)
        depth, where = self._steps
        flat, every, start = np.ascontiguousarray(bins).ravel(), np.arange(n), np.maximum(self.feature, 0) * n
        for _ in range(depth):
            at = where[at * SLOTS + flat[start[at] + every]]
        return at

    @cached_property
    def _steps(self) -> tuple[int, np.ndarray]:
        """The tree's depth, and the node that follows each node and bin; a leaf follows itself."""
        inner = np.flatnonzero(self.left >= 0)
        where = np.repeat(np.arange(len(self.left))[:, None], SLOTS, axis=1)
        left = np.arange(SLOTS) <= self.bin[inner, None]
        left[:, MISSING] = self.missing_left[inner]
        where[inner] = np.where(left, self.left[inner, None], self.right[inner, None])
        depth = np.zeros(len(self.left), np.int64)
        for k in inner.tolist():  # a node stands before its children
            depth[[self.left[k], self.right[k]]] = depth[k] + 1
        return int(depth.max()), where.ravel()

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.ends(bins)]


@dataclass
class Ensemble:
    """A start value and trees whose values are added; ``edges`` are the upper ends of each feature's bins but the last."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return binned(columns, self.edges)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for t in self.trees:
            out += t(bins)
        return out

    def prediction(self) -> Column:
        """The model's prediction from the columns of its features; null and NaN are missing."""

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.predict(self.binned([c.to_numpy(dtype=np.float64) for c in columns])))

        return score(*[F.col(c).cast("double") for c in self.features])


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """A row of bins (uint8) for each feature."""
    out = np.empty((len(columns), len(columns[0]) if columns else 0), dtype=np.uint8)
    for k, (x, e) in enumerate(zip(columns, edges, strict=True)):
        out[k] = np.where(np.isnan(x), MISSING, np.searchsorted(e, x, side="left"))
    return out


def bin_edges(df: DataFrame, features: list[str], bins: int = 64) -> list[np.ndarray]:
    """Upper ends of up to ``bins`` bins of about equal counts for each feature, from all rows; missing values don't count."""
    if not 2 <= bins <= MISSING:
        raise ValueError("a feature has 2 to 255 bins")
    points = [k / bins for k in range(1, bins)]
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features}
    row = df.agg(*[F.percentile_approx(x[c], points, 10_000).alias(f"e{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"e{k}"] or [], dtype=np.float64)) for k in range(len(features))]
