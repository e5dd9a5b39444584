"""Splits of rows by group and by time."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.sources.io import quoted

from .numbers import row_numbers
from .quantiles import exact_quantiles

#: Seeds of repeated splits.
SEEDS = (42, 7, 123, 2024, 31337)


def group_holdout(df: DataFrame, group: str, seed: int, share: float = 0.2) -> DataFrame:
    """``is_test``: the first ceil(share * groups) groups in the order of a hash with the seed; groups stay whole.

    The hash at the cut is found by counting groups by ever longer beginnings of their hashes; each row is then decided
    by its own.  Rows without a group are training rows.
    """
    key = F.sha2(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed))), 256)
    hashes = df.where(F.col(group).isNotNull()).select(group).distinct().select(key.alias("h"))
    n = hashes.count()
    cut = _nth_hash(hashes, math.ceil(share * n)) if n and share > 0 else ""
    return df.withColumn("is_test", F.coalesce(F.when(F.col(group).isNotNull(), key) <= cut, F.lit(False)))


def _nth_hash(hashes: DataFrame, n: int, few: int = 1000) -> str:
    """The nth smallest of distinct hexadecimal hashes (column h); a count of 4096 numbers for each three digits."""
    begin, before = "", 0
    while True:
        inside = hashes.where(F.col("h").startswith(begin))
        for r in sorted(inside.groupBy(F.substring("h", len(begin) + 1, 3).alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()):
            if before + r.c >= n:
                begin += r.d
                break
            before += r.c
        if r.c <= few:
            return sorted(x.h for x in hashes.where(F.col("h").startswith(begin)).collect())[n - before - 1]


def group_holdouts(df: DataFrame, group: str, seeds: list[int], by: str | None = None, share: float = 0.2) -> DataFrame:
    """``is_test_<seed>`` for each seed, as ``group_holdout`` gives it within each value of ``by``, in a few jobs for all.

    The hashes at all cuts are found together, by counting groups by ever longer beginnings.  ``by`` has few values; rows
    without a group are training rows.
    """
    of = F.col(by).cast("string") if by else F.lit("")
    key = lambda seed: F.sha2(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed))), 256)
    groups = df.where(F.col(group).isNotNull()).select(of.alias("b"), F.col(group)).distinct()
    hashes = groups.select("b", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), key(s).alias("h")) for s in seeds])).alias("x")).select("b", "x.seed", "x.h")
    # For each cut: the beginning of its hash so far, and how many of those within it come up to the cut.
    cuts: dict[tuple[str, int], tuple[str, int]] | None = None
    done: dict[tuple[str, int], str] = {}
    for depth in range(0, 64, 3):
        if cuts is not None and not cuts:
            break
        inside = hashes
        if cuts is not None:
            wanted = df.sparkSession.createDataFrame([(b, s, begin) for (b, s), (begin, _) in cuts.items()], "wb string, ws int, begin string")
            inside = hashes.join(F.broadcast(wanted), F.col("b").eqNullSafe(F.col("wb")) & (F.col("seed") == F.col("ws")) & F.col("h").startswith(F.col("begin")))
        counts: dict[tuple[str, int], list[tuple[str, int]]] = {}
        for r in inside.groupBy("b", "seed", F.substring("h", depth + 1, 3).alias("d")).agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("least")).collect():
            counts.setdefault((r.b, r.seed), []).append((r.d, r.c, r.least))
        if cuts is None:
            cuts = {k: ("", math.ceil(share * sum(c for _, c, _ in v))) for k, v in counts.items()}
        after = {}
        for k, (begin, left) in cuts.items():
            if left < 1:
                done[k] = ""
                continue
            for d, c, least in sorted(counts[k]):
                if left <= c:
                    if c == 1:
                        done[k] = least
                    else:
                        after[k] = (begin + d, left)
                    break
                left -= c
        cuts = after
    out = {}
    for s in seeds:
        cut = F.lit(None).cast("string")
        for (b, seed), h in done.items():
            if seed == s:
                cut = F.when(of.eqNullSafe(F.lit(b)), F.lit(h)).otherwise(cut)
        out[f"is_test_{s}"] = F.coalesce(F.when(F.col(group).isNotNull(), key(s)) <= cut, F.lit(False))
    return df.withColumns(out)


#: Groups that a seeded permutation on the driver takes (8 bytes each there, a bit each on executors).
MOST_PERMUTED = 1 << 28


def group_holdout_exact(df: DataFrame, group: str, seed: int, share: float = 0.2) -> DataFrame:
    """(group, is_test) of each distinct group: a seeded permutation of the sorted groups, as the usual library draws it.

    Groups are numbered by Spark; the driver permutes numbers alone, and executors get a bit for each.  Null is no group.
    """
    groups, n = row_numbers(df.select(group).where(F.col(group).isNotNull()).distinct(), [group], "__number")
    if n > MOST_PERMUTED:
        raise ValueError(f"{n} groups are too many for a permutation on the driver; use group_holdout")
    picked = np.zeros(n, dtype=bool)
    picked[np.random.RandomState(seed).permutation(n)[: math.ceil(share * n)]] = True
    bits = df.sparkSession.sparkContext.broadcast(np.packbits(picked))

    @F.pandas_udf("boolean")
    def is_test(number: pd.Series) -> pd.Series:
        k = number.to_numpy()
        return pd.Series(bits.value[k >> 3] >> (7 - (k & 7)) & 1 == 1)

    return groups.select(group, is_test("__number").alias("is_test"))


def fold_plan(histogram: dict[int, int], k: int) -> dict[int, list[tuple[int, list[int]]]]:
    """For each size, from which rank on groups of that size go to which folds in turn; one of the folds' orders after another.

    Largest first, each group to the fold with fewest rows so far, the first of equal ones.  The folds that one more
    group each doesn't lift above the next fold take turns, so only changes of that set are worked out, not each group.
    """
    load, plan = [0] * k, {}
    for size in sorted(histogram, reverse=True):
        left, rank, parts = histogram[size], 0, []
        while left:
            order = sorted(range(k), key=lambda i: (load[i], i))
            first = order[0]
            turn = [i for i in order if (load[i], i) < (load[first] + size, first)]
            rest = order[len(turn) :]
            rounds = max(1, -(-(load[rest[0]] - load[first]) // size) - 1) if rest else left
            parts.append((rank, turn))
            n = min(left, rounds * len(turn))
            for place, i in enumerate(turn):
                load[i] += size * ((n - place + len(turn) - 1) // len(turn) if n > place else 0)
            rank, left = rank + n, left - n
        plan[size] = parts
    return plan


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold, rows): largest groups first, by name among equal ones, each to the fold with fewest rows so far.

    The driver holds how many groups there are of each size (sizes add up to the rows, so there are few different
    ones); groups find their fold by their rank among those of their size.  Null is no group; k is from 2 to 5 and not
    above the number of groups.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    ranked, n = row_numbers(sizes, [F.col("rows").desc(), F.col(group).cast("string")], "__rank")
    histogram = {r[0]: r[1] for r in sizes.groupBy("rows").count().collect()}
    plan = fold_plan(histogram, max(2, min(k, 5, n)))
    found: dict[int, tuple[int, list[int], list[list[int]]]] = {}
    before = 0
    for size, parts in plan.items():
        found[size] = (before, [p[0] for p in parts], [p[1] for p in parts])
        before += histogram[size]
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("int")
    def fold(rows: pd.Series, rank: pd.Series) -> pd.Series:
        out = []
        for size, r in zip(rows.tolist(), rank.tolist(), strict=True):
            start, begins, turns = shared.value[size]
            at = bisect.bisect_right(begins, r - start) - 1
            out.append(turns[at][(r - start - begins[at]) % len(turns[at])])
        return pd.Series(out, dtype="int32")

    return ranked.select(group, fold("rows", "__rank").alias("fold"), "rows")


#: Rows of a group that one task takes; groups above it that may be told to all tasks.
MOST_ROWS, MOST_HOT = 1 << 20, 1 << 16


def with_group_least(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """``df`` with the least value of each row's group (null is a group) as a new column.

    The least values are found by an aggregation that combines first, and joined back; groups of more than a million
    rows are dealt over as many parts as their size asks for, so no task gets a whole large group.
    """
    rows = df.withColumn("__v", value)
    least = rows.groupBy(group).agg(F.min("__v").alias("__least"), F.count(F.lit(1)).alias("__rows"))
    limit = max(MOST_ROWS, -(-rows.count() // MOST_HOT))
    parts = F.ceil(F.col("__rows") / F.lit(limit)).cast("int")
    hot = least.where(F.col("__rows") > limit).select(F.col(group).alias("__hot"), parts.alias("__parts"))
    # At most MOST_HOT groups can be above the limit.
    told = rows.join(F.broadcast(hot), F.col(group).eqNullSafe(F.col("__hot")), "left")
    told = told.withColumn("__salt", F.when(F.col("__parts") > 1, F.pmod(F.monotonically_increasing_id(), F.col("__parts"))).otherwise(0).cast("int"))
    spread = least.select(F.col(group).alias("__g"), "__least", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__s"))
    joined = told.join(spread, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__salt") == F.col("__s")))
    return joined.select(*[F.col(quoted(c)) for c in df.columns], F.col("__least").alias(name))


def forward_split(df: DataFrame, group: str, ts: str, share: float = 0.2) -> DataFrame:
    """``job_time`` (first time of the group), ``cut`` and ``is_test``: groups after the cut.

    The cut is the (1 - share) quantile of job_time over rows, so large groups weigh more; equal times and rows without
    a time are training rows.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    timed = with_group_least(df, group, seconds, "job_time")
    (cut,) = exact_quantiles(timed, "job_time", [1 - share])
    return timed.withColumn("cut", F.lit(cut).cast("double")).withColumn("is_test", F.coalesce(F.col("job_time") > F.col("cut"), F.lit(False)))
