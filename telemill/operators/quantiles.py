"""Ranks and exact quantiles of columns and of groups of any size.

A group of up to a million rows is one task's work: it is sorted there, or counted in one buffer.  What is larger is
counted by cells instead, for all such groups at once: first by the sixteenth of a power of two in which a value lies,
then, if a cell that matters still holds more than a million rows, by 4096 equal parts of what lies between its own
least and largest value, and so on.  A double has so few digits that four such passes part any cell, and each pass is an
aggregation that combines before it shuffles.  All these parts follow the order of values, as every step of arithmetic
used here does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.sources.scratch import written

#: Rows of a group, or of a cell, that one task takes; parts of a power of two; parts of a cell.
MOST, SIXTEENTHS, PARTS = 1 << 20, 16, 4096


def _keyed(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(g, x): the group as one struct, in which nulls are values like others, and the value as a double, if there is one."""
    group = F.struct(*[F.col(c).alias(f"g{k}") for k, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))
    return df.where(F.col(column).isNotNull()).select(group.alias("g"), F.col(column).cast("double").alias("x"))


def _named(df: DataFrame, by: list[str], *others: str) -> DataFrame:
    return df.select(*[F.col(f"g.g{k}").alias(c) for k, c in enumerate(by)], *others)


def first_cell(x: Column) -> Column:
    """A whole number that never falls as x grows: its sign and the sixteenth of a power of two; NaN is the largest."""
    inside = F.floor((F.log2(F.abs(x)) + 1100) * SIXTEENTHS)
    return F.when(F.isnan(x), 50_000).when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x) * 40_000).otherwise(F.signum(x) * inside).cast("long")


def _part(x: Column, low: Column, high: Column) -> Column:
    share = F.floor((x - low) / (high - low) * PARTS)
    return F.when(high > low, F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), share))).otherwise(0).cast("long")


def _cells(rows: DataFrame, digits: list[str], weight: str | None = None) -> DataFrame:
    """Rows, their weights, least and largest value of each cell of a group."""
    return rows.groupBy("g", *digits).agg(F.count(F.lit(1)).alias("rows"), (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def _beside(rows: DataFrame, cells: DataFrame, digits: list[str], columns: list[str]) -> DataFrame:
    """Rows with columns of their cell; rows of other cells go."""
    right = cells.select(*[F.col(c).alias(f"_{c}") for c in ("g", *digits, *columns)])
    same = [F.col(c) == F.col(f"_{c}") for c in ("g", *digits)]
    return rows.join(right, same).drop(*[f"_{c}" for c in ("g", *digits)])


def _finer(rows: DataFrame, cells: DataFrame, digits: list[str]) -> DataFrame:
    """Rows of the given cells with one digit more."""
    return _beside(rows, cells, digits, ["low", "high"]).withColumn(f"d{len(digits)}", _part(F.col("x"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def _before(cells: DataFrame, digits: list[str]) -> Column:
    """What lies before a cell among those that differ from it in the last digit alone: a few thousand at most."""
    w = Window.partitionBy("g", *digits[:-1]).orderBy(digits[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def _too_large(cells: DataFrame) -> bool:
    return bool(cells.where((F.col("rows") > MOST) & (F.col("low") < F.col("high"))).limit(1).count())


def _large_groups(rows: DataFrame) -> DataFrame | None:
    """(g, total) of groups that aren't one task's work, as a written table; None if there are none."""
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > MOST)
    if not large.limit(1).count():
        return None
    return written(large, "large-groups")


def ranked(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, x, n, before): each distinct value of a group as a double, its rows, and the rows of smaller values.

    Nulls are left out; a null in ``by`` is a group of its own.  Equal values are counted before they are shuffled.
    """
    rows = _keyed(df, column, by)
    counted = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    digits: list[str] = []
    before: Column = F.lit(0)
    if _large_groups(rows) is not None:
        counted = written(counted.withColumn("d0", first_cell(F.col("x"))), "ranked")
        digits = ["d0"]
        while True:
            cells = _cells(counted, digits, "n")
            cells = written(cells.withColumn("before", _before(cells, digits)), "ranked-cells")
            counted = _beside(counted, cells, digits, ["before"]).withColumnRenamed("_before", f"b{len(digits)}")
            before = before + F.col(f"b{len(digits)}")
            if not _too_large(cells):
                break
            counted = written(_finer(counted, cells, digits), "ranked")
            digits = [*digits, f"d{len(digits)}"]
    w = Window.partitionBy("g", *digits).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return _named(counted.withColumn("before", before + F.coalesce(F.sum("n").over(w), F.lit(0))), by, "x", "n", "before")


def _ranks(points: list[float]) -> Column:
    """The places, from 0, of the values that quantiles of ``total`` values need: those below and above each point."""
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(p)) * (F.col("total") - 1)), F.ceil(F.lit(float(p)) * (F.col("total") - 1))) for p in points])))


def _quantiles_of_large(rows: DataFrame, large: DataFrame, points: list[float]) -> DataFrame:
    """(g, quantiles) of large groups, by narrowing down the cells that hold what is wanted."""
    wanted = large.select("g", "total", _ranks(points).alias("ranks"))
    digits, rows = ["d0"], rows.withColumn("d0", first_cell(F.col("x")))
    cells = _cells(_beside(rows, large, [], []), digits)
    cells = cells.withColumn("before", _before(cells, digits))
    while True:
        held = _beside(cells, wanted, [], ["ranks"])
        cells = written(held.where(F.exists("_ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).drop("_ranks"), "quantile-cells")
        if not _too_large(cells):
            break
        rows = _finer(rows, cells, digits)
        digits = [*digits, f"d{len(digits)}"]
        finer = _cells(rows, digits)
        inside = finer.withColumn("inner", _before(finer, digits))
        cells = _beside(inside, cells, digits[:-1], ["before"]).select("g", *digits, "rows", "n", "low", "high", (F.col("inner") + F.col("_before")).alias("before"))
    counted = _beside(rows, cells.where("low < high"), digits, []).groupBy("g", *digits, "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g", *digits).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("inner", F.coalesce(F.sum("n").over(w), F.lit(0)))
    values = _beside(counted, cells, digits, ["before"]).select("g", "x", "n", (F.col("inner") + F.col("_before")).alias("before"))
    values = values.unionByName(cells.where("not low < high").select("g", F.col("low").alias("x"), "n", "before"))
    found = _beside(values, wanted, [], ["ranks", "total"]).select("g", "x", "_total", F.explode(F.filter("_ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).alias("r"))
    by_rank = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("m"), F.max("_total").alias("total"))

    def value(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.element_at("m", F.floor(place)), F.element_at("m", F.ceil(place))
        return F.when(low == high, low).otherwise((F.floor(place) + 1 - place) * low + (place - F.floor(place)) * high)

    return by_rank.select("g", F.array(*[value(p) for p in points]).alias("q"))


def group_quantiles(df: DataFrame, column: str, points: list[float], by: list[str], name: str = "quantiles") -> DataFrame:
    """(by, name): linearly interpolated quantiles, as an array, of each group that has values."""
    rows = _keyed(df, column, by)
    large = _large_groups(rows)
    few = rows if large is None else rows.join(large.select(F.col("g").alias("_g")), F.col("g") == F.col("_g"), "left_anti")
    out = few.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in points])).alias("q"))
    if large is not None:
        out = out.unionByName(_quantiles_of_large(rows, large, points))
    return _named(out.withColumnRenamed("q", name), by, name)


def column_quantiles(df: DataFrame, columns: list[str], points: list[float]) -> list[list[float | None]]:
    """Linearly interpolated quantiles of all values of each column that are numbers; None for each point without any."""
    if not columns:
        return []
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    if df.count() <= MOST:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in points])).alias(f"q{k}") for k, c in enumerate(x)]).first()
        return [list(row[f"q{k}"] or [None] * len(points)) for k in range(len(columns))]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("x")) for k, c in enumerate(x)])).alias("c")).select("c.k", "c.x")
    found = {r.k: list(r.quantiles) for r in group_quantiles(long, "x", points, ["k"]).collect()}
    return [found.get(k, [None] * len(points)) for k in range(len(columns))]


def exact_quantiles(df: DataFrame, column: str, points: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of all values that aren't null; None for each point without values."""
    row = group_quantiles(df, column, points, []).first()
    return list(row[0]) if row else [None] * len(points)


def with_medians(groups: DataFrame, rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``groups`` (one row a group) with the median of each column under its new name."""
    rows = rows.select(*[F.col(c).alias(f"__{k}r") for k, c in enumerate(by)], *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(columns)])
    keys = [f"__{k}r" for k in range(len(by))]
    if not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).limit(1).count():
        found = [rows.groupBy(*keys).agg(*[F.percentile(f"__x{k}", F.lit(0.5)).alias(name) for k, name in enumerate(columns.values())])]
    else:
        found = [group_quantiles(rows, f"__x{k}", [0.5], keys, "__q").select(*keys, F.get("__q", F.lit(0)).alias(name)) for k, name in enumerate(columns.values())]
    for right in found:
        groups = groups.join(right, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)], "left").drop(*keys)
    return groups
