"""Filters for usable rows and columns, and data contracts.

Facts about many columns come from one pass of wide aggregates (in groups of columns, so that generated code stays
small); only those few numbers for each column reach the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.nulls import ROW_TOKENS, SUCCESS_TOKENS, is_blank, is_true, text_of, unparsable
from telemill.sources.io import quoted

from .columns import CHANNEL, DEVICE_PREFIXES

AT_ONCE = 100


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def usable(name: str) -> Column:
    """Whether a column says that its side is available; the name's form tells how to read it."""
    c = F.col(quoted(name))
    if name.endswith("_dag_ok"):
        return is_true(c)
    if name.endswith("_sim_status"):
        return F.lower(text_of(c)).isin(*SUCCESS_TOKENS)
    if name.startswith("hellinger_"):
        x = text_of(c).try_cast("double")
        return x.isNotNull() & ~F.isnan(x)
    return ~is_blank(c, ROW_TOKENS, ignore_case=True)


def side_available(df: DataFrame, names: list[str]) -> Column:
    """One of the columns that exist is usable; without any the side fails."""
    return any_of([F.coalesce(usable(n), F.lit(False)) for n in names if n in df.columns])


def both_sides(df: DataFrame, logical: list[str], native: list[str]) -> DataFrame:
    return df.where(side_available(df, logical) & side_available(df, native))


def base_filter(df: DataFrame, where: str | None = None, resource: str | None = None, excluded: list[str] = ()) -> DataFrame:
    """Free predicate, resource not blank, resource not excluded (a null one is)."""
    conditions = []
    if where:
        conditions.append(F.expr(where))
    if resource:
        conditions.append(~is_blank(F.col(resource)))
        if excluded:
            conditions.append(~F.col(resource).isin(*excluded))
    return df.where(all_of(conditions))


def removed_counts(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before, after and removed, in one pass."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("n_before"), kept.alias("n_after"), (F.count(F.lit(1)) - kept).alias("n_removed"))


def invalid_rows(df: DataFrame, logical_ok: Column, native_ok: Column, policy: str = "keep") -> DataFrame:
    """``row_drop_reason``, and without the rows that the policy (keep, drop_any_fail, drop_both_fail) drops."""
    reason = F.when(~logical_ok & ~native_ok, "both_failed").when(~logical_ok, "logical_failed").when(~native_ok, "native_failed")
    out = df.withColumn("row_drop_reason", reason)
    if policy == "keep":
        return out
    if policy == "drop_any_fail":
        return out.where("row_drop_reason is null")
    if policy == "drop_both_fail":
        return out.where("row_drop_reason is null or row_drop_reason != 'both_failed'")
    raise ValueError(f"unknown policy {policy}")


def column_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: values, least and largest (as text), numbers, zeros, NaN-free share; and rows in all."""
    out: dict[str, dict] = {}
    for at in range(0, len(columns), AT_ONCE):
        part = columns[at : at + AT_ONCE]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for k, c in enumerate(part):
            x = F.col(quoted(c))
            aggs += [F.count(x).alias(f"n{k}"), F.min(x).cast("string").alias(f"a{k}"), F.max(x).cast("string").alias(f"b{k}"), F.count_if(unparsable(x)).alias(f"u{k}")]
        row = df.agg(*aggs).first()
        for k, c in enumerate(part):
            out[c] = {"rows": row["rows"], "count": row[f"n{k}"], "min": row[f"a{k}"], "max": row[f"b{k}"], "unparsable": row[f"u{k}"]}
    return out


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_distinct, least and largest as numbers, and coverage.

    One long pass: each row gives a row for each column, equal values of a column are counted before they are shuffled.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("text"), F.col(quoted(c)).try_cast("double").alias("number")) for c in columns])
    values = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "text").agg(F.count(F.lit(1)).alias("rows"), F.min("number").alias("number"))
    some = F.col("text").isNotNull()
    out = values.groupBy("column").agg(F.sum(F.when(some, F.col("rows")).otherwise(0)).alias("n"), F.count("text").alias("n_distinct"), F.min("number").alias("least"), F.max("number").alias("largest"), F.sum("rows").alias("rows"))
    return out.select("column", "n", "n_distinct", "least", "largest", F.try_divide(F.col("n").cast("double"), F.col("rows")).alias("coverage"))


def degenerate_columns(df: DataFrame, columns: list[str], exempt: list[str] = (), sparse: float = 0.01) -> list[tuple[str, str]]:
    """(column, reason): empty, constant or sparse.  A channel's columns go only if all of them are degenerate."""
    facts = column_facts(df, columns)
    reason: dict[str, str] = {}
    for c, f in facts.items():
        if c in exempt:
            continue
        if f["count"] == 0:
            reason[c] = "empty"
        elif f["min"] == f["max"]:
            reason[c] = "constant"
        elif f["count"] < sparse * f["rows"]:
            reason[c] = "sparse"
    channel = {c: m["channel"] for c in columns if (m := CHANNEL.match(c))}
    alive = {channel[c] for c in columns if c in channel and c not in reason}
    return [(c, r) for c, r in reason.items() if channel.get(c) not in alive or c not in channel]


def covered_columns(train: DataFrame, candidates: list[str], threshold: float = 0.10, always: list[str] = ()) -> list[str]:
    """Candidates with values in that share of the training rows or more, in order; absent ones are ignored."""
    have = [c for c in dict.fromkeys(candidates) if c in train.columns]
    facts = column_facts(train, have)
    return [c for c in have if c in always or (facts[c]["rows"] and facts[c]["count"] >= threshold * facts[c]["rows"])]


def check_numbers(df: DataFrame, columns: list[str]) -> None:
    if bad := [c for c, f in column_facts(df, columns).items() if f["unparsable"]]:
        raise ValueError(f"not numbers: {', '.join(bad)}")


# Contracts: every check is one row (check, violations), all from one pass where they can be.


def contract(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations, ok): rows for which a condition isn't true; a null condition passes."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(f"v{k}") for k, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"v{k}").alias("violations")) for k, name in enumerate(checks)])
    return counts.select(F.explode(rows).alias("r")).select("r.check", "r.violations", (F.col("r.violations") == 0).alias("ok"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids are integers 1..N without gaps: violations count a wrong start and what the largest is off."""
    c = F.col(quoted(column))
    out = df.agg(F.min(c).alias("a"), F.max(c).alias("b"), F.count_distinct(c).alias("n"))
    wrong = F.when(F.col("a") != 1, F.lit(1)).otherwise(0) + F.coalesce(F.abs(F.col("b") - F.col("n")), F.lit(0))
    return out.select(F.lit(f"{column} dense").alias("check"), wrong.cast("long").alias("violations"), (wrong == 0).alias("ok"))


def unique(df: DataFrame, column: str) -> DataFrame:
    twice = df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v"))
    return twice.select(F.lit(f"{column} unique").alias("check"), F.col("v").alias("violations"), (F.col("v") == 0).alias("ok"))


def hour_resolution(c: Column) -> Column:
    return F.date_trunc("hour", c) == c


def in_order(*times: Column) -> Column:
    """Each not after the next; nulls pass."""
    return all_of([F.coalesce(a <= b, F.lit(True)) for a, b in zip(times[:-1], times[1:], strict=True)])


def channel_checks(columns: list[str], slack: float = 1e-6) -> dict[str, Column]:
    """Of each channel with statistics: least <= mean <= largest, no negative deviation, null together."""
    by: dict[str, set[str]] = {}
    for c in columns:
        if m := CHANNEL.match(c):
            by.setdefault(m["channel"], set()).add(m["statistic"])
    out = {}
    for ch, have in by.items():
        col = lambda s, ch=ch: F.col(quoted(f"{ch}__{s}"))
        if {"mean", "min", "max"} <= have:
            out[f"{ch} order"] = (col("min") <= col("mean") + slack) & (col("mean") <= col("max") + slack)
            out[f"{ch} null together"] = (col("mean").isNull() == col("min").isNull()) & (col("mean").isNull() == col("max").isNull())
        if "sd" in have:
            out[f"{ch} deviation"] = col("sd") >= 0
    return out


def incomplete_channels(columns: list[str]) -> list[str]:
    by: dict[str, set[str]] = {}
    for c in columns:
        if m := CHANNEL.match(c):
            by.setdefault(m["channel"], set()).add(m["statistic"])
    return sorted(c for c, s in by.items() if s - {"count", "fallback_used"} not in ({"mean", "min", "max", "sd"}, {"value"}))


def device_scope(columns: dict[str, str], device: str = "device") -> dict[str, Column]:
    """Columns of one device are null in rows of others."""
    return {f"{c} only {d}": (F.col(device) == d) | F.col(quoted(c)).isNull() for c, d in columns.items()}


def blocked_names(columns: list[str], pattern: str) -> list[str]:
    return [c for c in columns if re.search(pattern, c, re.I)]


def carried_forward(df: DataFrame, channel: str, prefix: str, least_rows: int = 100, least_channels: int = 5, share: float = 0.9) -> DataFrame:
    """Whether channels hold single carried values rather than windows of readings: one row.

    ``df`` has a row for each channel and window, with columns <prefix>__count, __min and __max.  A channel is suspect
    if every positive count is 1, or if least and largest are equal in every window that isn't all zero; it is judged
    if it has ``least_rows`` such windows.
    """
    n, a, b = (F.col(quoted(f"{prefix}__{s}")) for s in ("count", "min", "max"))
    seen = a.isNotNull() & b.isNotNull() & ~((a == 0) & (b == 0))
    by = df.where(F.col(channel).isNotNull()).groupBy(channel).agg(
        (F.count_if(n > 0) >= least_rows).alias("counted"), (F.count_if((n > 0) & (n != 1)) == 0).alias("single"), (F.count_if(seen) >= least_rows).alias("judged"), (F.count_if(seen & (a != b)) == 0).alias("flat")
    )
    sums = by.agg(*[F.count_if(F.col(of)).alias(of) for of in ("counted", "judged")], F.count_if(F.col("counted") & F.col("single")).alias("single"), F.count_if(F.col("judged") & F.col("flat")).alias("flat"))
    single, flat = (F.try_divide(F.col(x).cast("double"), F.col(of).cast("double")) for x, of in (("single", "counted"), ("flat", "judged")))
    bad = ((F.col("counted") >= least_channels) & (single >= share)) | ((F.col("judged") >= least_channels) & (flat >= share))
    return sums.select(single.alias("share_single"), flat.alias("share_flat"), F.coalesce(bad, F.lit(False)).alias("carried_forward"))


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled share, zero share, suspect) of feature columns that look filled with zeros."""
    rows = [F.struct(F.lit(c).alias("column"), F.avg(F.col(quoted(c)).isNotNull().cast("double")).alias("filled"), F.avg((F.coalesce(F.col(quoted(c)), F.lit(1)) == 0).cast("double")).alias("zeros")) for c in columns]
    wide = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r"))
    return wide.select("r.column", "r.filled", "r.zeros", ((F.col("r.filled") > 0.99) & (F.col("r.zeros") > 0.5)).alias("suspect"))


def compare_expected(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """label, value, actual, status (ok, DIFF, skip) by tolerance; both have label, expected has tolerance."""
    both = expected.join(actual.withColumnRenamed("value", "actual"), "label", "left")
    status = F.when(F.col("actual").isNull(), "skip").when(F.abs(F.col("actual") - F.col("value")) <= F.col("tolerance"), "ok").otherwise("DIFF")
    return both.select("label", "value", "actual", "tolerance", status.alias("status"))


def check_bundle(files: set[str], required: set[str], optional: set[str] = frozenset()) -> list[str]:
    return [f"missing {f}" for f in sorted(required - files)] + [f"unexpected {f}" for f in sorted(files - required - optional)]


def check_portal_record(record: dict, title: str | None = None, license: str | None = None) -> tuple[list[str], list[str]]:
    """(failures, warnings) of a portal record: its title and license, and texts that still have to be filled in."""
    out = [f"no {k}" for k in ("title", "license") if not record.get(k)]
    out += [f"another {k}" for k, v in (("title", title), ("license", license)) if v and record.get(k) and str(record[k]).lower() != v.lower()]
    return out, [f"fill in {k}" for k, v in sorted(record.items()) if isinstance(v, str) and "FILL-IN" in v]


def check_dictionary(columns: list[str], described: list[dict], internal: str | None = None) -> list[str]:
    """What is wrong with a data dictionary: rows of column, description, source, group and device_scope."""
    names = [r["column"] for r in described]
    out = [f"not described: {c}" for c in columns if c not in names] + [f"described but absent: {c}" for c in names if c not in columns]
    out += ["order differs"] if set(columns) == set(names) and columns != names else []
    for field in ("description", "source", "group", "device_scope"):
        out += [f"no {field}: {r['column']}" for r in described if not str(r.get(field) or "").strip()]
    out += [f"unresolved source: {r['column']}" for r in described if re.search(r"[?]|unknown", str(r.get("source") or ""))]
    return out + [f"internal document: {r['column']}" for r in described if internal and re.search(internal, str(r.get("description") or ""))]


def check_stated_counts(stated: dict[str, dict[str, object]], found: dict[str, object]) -> list[str]:
    """What documents (a manifest, file metadata, a README) say of counts against what was found."""
    return [f"{where}: {what} is {v}, not {found[what]}" for where, facts in stated.items() for what, v in facts.items() if what in found and str(v).replace(",", "") != str(found[what])]


def validate_release(df: DataFrame, found: dict[str, list[str]], device: str = "device", job: str = "job_id", key: str = "circuit_id", time: list[Column] = (), domain: dict[str, Column] | None = None) -> DataFrame:
    """(check, violations, ok) of a data set to be published.

    ``found`` has what checks of names and documents found, by the check's name; the others are read off the data.
    """
    spark = df.sparkSession
    sensors = {c: d for c in df.columns for d, prefixes in DEVICE_PREFIXES.items() if c.startswith(prefixes)}
    names = {**found, "channels complete": incomplete_channels(df.columns), "published names": [c for c in sensors if not re.fullmatch(r"(sc|ion)_\w+", c)], "completion anchor": [] if has_anchor(df.columns) else ["none"]}
    extremes = {c for c in df.columns if (m := CHANNEL.match(c)) and m["statistic"] in ("min", "max", "sd")}
    facts = column_facts(df, df.columns)
    names["no empty columns"] = [c for c, f in facts.items() if not f["count"]]
    names["no single-valued columns"] = [c for c, f in facts.items() if f["count"] and f["min"] == f["max"] and c != "status" and c not in extremes]
    driver = spark.createDataFrame([(n, len(v), not v) for n, v in names.items()], "check string, violations long, ok boolean")
    checks = channel_checks(df.columns) | device_scope(sensors, device) | (domain or {})
    if time:
        checks["times in order"] = in_order(*time)
    zeros = zero_filled(df, list(sensors)).where("suspect").agg(F.count(F.lit(1)).alias("n"))
    enough = max(3, len(sensors) // 10)
    zeros = zeros.select(F.lit("not filled with zeros").alias("check"), F.when(F.col("n") >= enough, F.col("n")).otherwise(0).alias("violations"), (F.col("n") < enough).alias("ok"))
    jobs = df.where(F.col(job).isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{job} there").alias("check"), F.col("n").alias("violations"), (F.col("n") == 0).alias("ok"))
    return reduce(DataFrame.unionByName, [driver, contract(df, checks), unique(df, key), zeros, jobs])


def check_rows_kept(before: int, after: int) -> None:
    if before != after:
        raise ValueError(f"{before} rows before, {after} after")


def has_anchor(columns: list[str], names: tuple[str, ...] = ("timestamp_completed_utc", "completed_hour_utc")) -> bool:
    """Whether alignment with sensors can be dated; without a completion time it may be stale."""
    return any(n in columns for n in names)


def report(rows: list[tuple[str, bool, str]]) -> tuple[str, int]:
    """Text and exit code of checks (name, ok, detail)."""
    return "\n".join(f"{'PASS' if ok else 'FAIL'} {name} {detail}".rstrip() for name, ok, detail in rows), int(not all(ok for _, ok, _ in rows))


def contract_table(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
