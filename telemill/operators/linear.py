"""Many straight-line models of one table by a fixed number of passes, however many there are.

Rows that take the same part in all models (training, testing or none) form a cell.  One aggregation gives each cell's
moments: counts, sums and products of all columns, about means that a pass before has told, so offsets do no harm.  Each
model's training moments are the sum of its cells', and it is solved on the driver; a last pass gives all errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of which the driver takes moments, and sums that one pass forms.
MOST_CELLS, AT_ONCE = 100_000, 400


@dataclass
class Case:
    """A model: the rows that it learns from, those that it is scored on, and its features.

    Features with values in less than ``coverage`` of the training rows are left out unless they are in ``always``.
    """

    train: Column
    test: Column
    features: list[str]
    coverage: float = 0.0
    always: list[str] = field(default_factory=list)


@dataclass
class Fit:
    columns: list[str]
    coefficients: np.ndarray
    intercept: float
    n_train: int
    fill: dict[str, float]


@dataclass
class Score:
    fit: Fit
    r2: float | None
    mae: float | None
    rmse: float | None
    n_test: int


def _value(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def _present(c: str, fill: dict[str, float]) -> Column:
    """A feature's column: its value, or the mean of all rows where it is missing; a second one marks what is missing.

    With both, any constant in place of missing values gives the same predictions, so none has to be found for each model.
    """
    x = _value(c.removesuffix("__missing"))
    return x.isNull().cast("double") if c.endswith("__missing") else F.coalesce(x, F.lit(fill[c]))


def solve(moments: np.ndarray, means: np.ndarray, use: list[int], y: int) -> tuple[np.ndarray, float]:
    """Coefficients of the columns ``use`` for column ``y`` and the intercept, from products of (1, columns - means).

    Of columns that depend on one another the solution of least norm is taken, in units of each column's deviation.
    """
    n = moments[0, 0]
    if not n:
        return np.zeros(len(use)), float("nan")
    at = [k + 1 for k in use]
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    unit = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(means + mean)), sd, np.inf)
    a = cov[np.ix_(use, use)] / np.outer(unit[use], unit[use])
    b = cov[use, y] / unit[use]
    coefficients = np.linalg.lstsq(a, b, rcond=1e-10)[0] / unit[use] if at else np.zeros(0)
    centre = means + mean
    return coefficients, float(centre[y] - coefficients @ centre[use])


def fits(df: DataFrame, target: str, cases: list[Case]) -> list[Fit]:
    """The models of all cases, by two passes over the rows that have a target."""
    features = list(dict.fromkeys(f for c in cases for f in c.features))
    columns = [x for f in features for x in (f, f"{f}__missing")]
    rows = df.where(_value(target).isNotNull())
    told = rows.agg(F.avg(_value(target)).alias("y"), *[f.alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("m", F.avg(_value(c))), ("n", F.avg(_value(c).isNull().cast("double"))))]).first()
    fill = {c: told[f"m{k}"] or 0.0 for k, c in enumerate(features)}
    means = np.array([*[told[f"{n}{k}"] or 0.0 for k in range(len(features)) for n in ("m", "n")], told.y or 0.0])
    values = [*[_present(c, fill) for c in columns], _value(target)]
    centred = [F.lit(1.0), *[v - float(m) for v, m in zip(values, means, strict=True)]]
    # Cases that share a condition share its column.
    conditions = {id(c.train): c.train for c in cases}
    place = {k: i for i, k in enumerate(conditions)}
    narrow = rows.select(*[F.coalesce(c, F.lit(False)).alias(f"t{k}") for k, c in enumerate(conditions.values())], *[v.alias(f"v{k}") for k, v in enumerate(centred)])
    keys, size = [f"t{k}" for k in range(len(conditions))], len(centred)
    if len(keys) > 16 and narrow.select(*keys).distinct().count() > MOST_CELLS:
        raise ValueError("the models' rows overlap in too many ways")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    total = np.zeros((len(cases), size, size))
    # Wide tables take a pass for each few hundred products.
    for start in range(0, len(pairs), AT_ONCE):
        some = pairs[start : start + AT_ONCE]
        cells = narrow.groupBy(*keys).agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in some]).collect()
        for r in cells:
            for k, c in enumerate(cases):
                if r[f"t{place[id(c.train)]}"]:
                    for i, j in some:
                        total[k, i, j] += r[f"s{i}_{j}"]
    out = []
    for k, c in enumerate(cases):
        m = total[k] + np.triu(total[k], 1).T
        n = m[0, 0]
        filled = {f: 1.0 - (m[0, 2 + 2 * i] / n + means[2 * i + 1]) if n else 0.0 for i, f in enumerate(features)}
        kept = [f for f in c.features if f in c.always or not c.coverage or filled[f] >= c.coverage]
        use = [2 * features.index(f) + d for f in kept for d in (0, 1)]
        coefficients, intercept = solve(m, means, use, len(columns))
        out.append(Fit([columns[u] for u in use], coefficients, intercept, int(round(n)), fill))
    return out


def prediction(fit: Fit) -> Column:
    out = F.lit(fit.intercept)
    for c, b in zip(fit.columns, fit.coefficients, strict=True):
        if b:
            out = out + _present(c, fit.fill) * float(b)
    return out


def scores(df: DataFrame, target: str, cases: list[Case]) -> list[Score]:
    """Each case's model and its errors on its test rows: three passes in all."""
    models, y, out = fits(df, target, cases), _value(target), []
    aggregates = []
    for k, (c, m) in enumerate(zip(cases, models, strict=True)):
        here = F.when(c.test, y)
        e = F.when(c.test, y - prediction(m)) if m.n_train else F.lit(None).cast("double")
        aggregates += [F.count(e).alias(f"n{k}"), F.sum(e * e).alias(f"s{k}"), F.avg(F.abs(e)).alias(f"a{k}"), F.var_pop(here).alias(f"v{k}")]
    row = df.where(y.isNotNull()).agg(*aggregates).first()
    for k, m in enumerate(models):
        n, squares, spread = row[f"n{k}"], row[f"s{k}"], row[f"v{k}"]
        out.append(Score(m, 1 - squares / (spread * n) if n and spread else None, row[f"a{k}"], (squares / n) ** 0.5 if n else None, n))
    return out
