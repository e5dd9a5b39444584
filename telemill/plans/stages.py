"""From raw job records to a typed data set: the build stages as functions from DataFrame to DataFrame.

Each stage is one lazy plan, so they can be chained without files in between, or written after any of them.  Payload
columns are ``circuit``, ``executed_circuit`` and ``result``; sides are ``logical`` (circuit) and ``native`` (executed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import distributions as d
from telemill.functions import payload, times
from telemill.functions.nulls import PAYLOAD_TOKENS, is_blank, number
from telemill.operators import circuits, columns, merge, quality, record_columns
from telemill.sources import blobs
from telemill.sources.io import quoted

SIDES = {"logical": "circuit", "native": "executed_circuit"}
#: Jobs whose programs a task reads and simulates, about.
JOBS = 1 << 11


def preprocess(jobs: DataFrame, where: str | None = None, excluded: list[str] = (), limit: int | None = None) -> DataFrame:
    """Jobs of a known resource that isn't excluded."""
    out = quality.base_filter(jobs, where, "executed_resource", list(excluded))
    return out.limit(limit) if limit else out


def spread(jobs: DataFrame) -> DataFrame:
    """Jobs over as many tasks as they ask for: a small file, which is one task's input, may hold very many programs."""
    return jobs.repartition(max(1, -(-jobs.count() // JOBS)))


def expand(jobs: DataFrame, drop_mismatches: bool = False) -> DataFrame:
    """One row for each part of a job; ``result`` becomes counts as JSON with sorted keys in ``result_expanded``."""
    parts = {c: payload.items(F.col(c)) for c in SIDES.values()} | {"result": payload.count_items(F.col("result"))}
    out = payload.expand_batches(jobs, "id", parts)
    names = {f"{c}_{k}": f"{c}_batch_raw_{k}" for c in parts for k in ("kind", "n", "error")}
    out = out.withColumnsRenamed(names | {"batch_mismatch": "batch_len_mismatch_circuit_vs_executed_vs_result"})
    counts = d.counts(F.col("result"))
    out = out.withColumns({
        "result_kind": F.when(is_blank(F.col("result"), PAYLOAD_TOKENS), "empty").when(counts.isNotNull(), "single").otherwise("unknown"),
        "result_expanded": d.counts_json(counts),
        "result_parse_error": d.counts_error(F.col("result")),
    })
    return out.where(~F.coalesce("batch_len_mismatch_circuit_vs_executed_vs_result", F.lit(False))) if drop_mismatches else out


def normalise(rows: DataFrame) -> DataFrame:
    """Format, syntax and a canonical text of both programs."""
    for side, c in SIDES.items():
        rows = circuits.with_structure(rows, c, f"__{side}")
        parsed = lambda f, side=side: F.col(f"__{side}.{f}")
        rows = rows.withColumns({
            f"{c}_format": payload.detect_format(F.col(c)), f"{c}_parse_ok": F.coalesce(parsed("parse_ok"), F.lit(False)), f"{c}_parse_error": F.when(F.col(c).isNull(), "empty program").otherwise(parsed("error")),
            f"{c}_source_syntax": F.coalesce(parsed("syntax"), payload.source_syntax(F.col(c))), f"{c}_qasm2_norm": parsed("canonical"), f"{c}_best_for_sim": F.coalesce(parsed("canonical"), F.col(c)),
        })
        rows = rows.drop(f"__{side}")
    return rows


def simulate(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Ideal counts of both programs with the row's shots."""
    for side, c in SIDES.items():
        rows = circuits.with_ideal(rows, f"{c}_best_for_sim", "shots", "sub_id", side, seed)
        rows = rows.withColumnRenamed(f"{side}_sim_error", f"ideal_result_{side}_error")
    return rows


def verify_order(rows: DataFrame, margin: float = 0.001, default: str = d.NORMAL, assume: str | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The bit order of measured results against both ideal ones, and results in that order.

    What a row and its other side leave open takes the order that dominates over all rows, so the rows are gone through
    twice; ``cut`` (such as a checkpoint) keeps what came before from being computed twice.
    """
    rows = cut(rows) if cut else rows
    share = lambda c: d.probabilities(F.transform_values(d.counts(F.col(c)), lambda k, v: v.cast("double")))
    rows = rows.withColumns({"__result": d.counts(F.coalesce("result_expanded", "result")), "__measured": share("result_expanded")} | {f"__ideal_{s}": share(f"ideal_result_{s}") for s in SIDES})
    for side in SIDES:
        raw = d.order_verdict(F.col("__measured"), F.col(f"__ideal_{side}"), margin)
        readable = F.col("__measured").isNotNull() & F.col(f"__ideal_{side}").isNotNull()
        rows = rows.withColumns({
            f"{side}_best_endianness_raw": F.when(readable, raw).otherwise(""), f"{side}_verify_status": F.when(readable, "SUCCESS").otherwise("FAILED"),
            f"{side}_verify_error": F.when(F.col("__measured").isNull(), F.concat(F.lit("result: "), F.coalesce("result_parse_error", F.lit("unparsable")))).when(~readable, "ideal: unparsable"),
        })
    raw_columns = [f"{s}_best_endianness_raw" for s in SIDES]
    rows = rows.join(F.broadcast(d.dominant(rows, raw_columns)))
    for side, other in (("logical", "native"), ("native", "logical")):
        order, fallback = d.resolve_order(F.col(f"{side}_best_endianness_raw"), F.col(f"{other}_best_endianness_raw"), F.col(f"dominant_{side}_best_endianness_raw"), F.col("dominant_all"), default, assume)
        rows = rows.withColumns({
            f"{side}_best_endianness": order, f"{side}_endianness_used_fallback": fallback, f"{side}_endianness_confident": F.col(f"{side}_best_endianness_raw").isin(d.NORMAL, d.REVERSED), f"result_aligned_{side}": d.counts_json(d.aligned(F.col("__result"), order)),
        })
    return rows.drop("__result", "__measured", *[f"__ideal_{s}" for s in SIDES], *[f"dominant_{c}" for c in raw_columns], "dominant_all")


def hellinger(rows: DataFrame) -> DataFrame:
    """Distance of measured and ideal distributions for both sides; one side may fail without the other."""
    share = lambda m: d.probabilities(F.transform_values(m, lambda k, v: v.cast("double")))
    for side in SIDES:
        text, mode, source = d.choose_source(F.col(f"result_aligned_{side}"), F.col("result"), F.col(f"{side}_best_endianness"), f"result_aligned_{side}", f"{side}_best_endianness")
        measured = d.counts(text)
        turned = F.when(mode == f"fallback:{d.REVERSED}", d.reverse_keys(measured)).otherwise(measured)
        rows = rows.withColumns({"__m": share(turned), "__i": share(d.counts(F.col(f"ideal_result_{side}"))), "__e": d.counts_error(text), "__f": d.counts_error(F.col(f"ideal_result_{side}"))})
        error = F.when(mode.isNull(), "mode: unknown").when(F.col("__e").isNotNull(), F.concat(F.lit("result: "), F.col("__e"))).when(F.col("__f").isNotNull(), F.concat(F.lit("ideal: "), F.col("__f")))
        rows = rows.withColumns({
            f"hellinger_{side}": F.when(error.isNull(), d.hellinger(F.col("__m"), F.col("__i"))), f"hellinger_{side}_mode_used": mode, f"hellinger_{side}_result_source": source, f"hellinger_{side}_error": error,
        }).drop("__m", "__i", "__e", "__f")
    return rows


def features(rows: DataFrame) -> DataFrame:
    """Structure of both programs and their comparison; none of a row's if one of its programs can't be read."""
    for side, c in SIDES.items():
        rows = circuits.with_structure(rows, f"{c}_best_for_sim", side)
    error = F.coalesce(*[F.when(~F.coalesce(F.col(f"{s}.parse_ok"), F.lit(False)), F.concat(F.lit(f"{s}: "), F.coalesce(F.col(f"{s}.error"), F.lit("empty program")))) for s in SIDES])
    rows = rows.withColumn("feature_error", error)
    ok = F.col("feature_error").isNull()
    wide = {f"{s}_{f}": F.when(ok, F.col(f"{s}.{f}")) for s in SIDES for f in circuits.FEATURES} | {n: F.when(ok, c) for n, c in circuits.comparison().items()}
    return rows.withColumns(wide).drop(*SIDES)


def dags(rows: DataFrame, policy: str = "keep") -> DataFrame:
    """Content address and metrics of both programs (the first candidate text that can be read)."""
    for side, c in SIDES.items():
        candidates = [f"{c}_best_for_sim", f"{c}_qasm2_norm"]
        _, source, fallback = merge.first_success([(n, F.when(~is_blank(F.col(n)), F.col(n))) for n in candidates])
        text, _, _ = merge.first_success([(n, F.when(~is_blank(F.col(n)), F.col(n))) for n in candidates])
        rows = circuits.with_structure(rows.withColumns({"__text": text, f"{side}_dag_source_col": source, f"{side}_dag_used_fallback": fallback}), "__text", "__p")
        ok = F.coalesce(F.col("__p.parse_ok"), F.lit(False))
        value = lambda f, ok=ok: F.when(ok, F.col(f"__p.{f}"))
        rows = rows.withColumns({
            f"{side}_dag_ok": ok, f"{side}_dag_attempts": F.when(F.col("__text").isNotNull(), 1).otherwise(0), f"{side}_dag_error": payload.shorten(F.when(F.col("__text").isNull(), "empty text").otherwise(F.col("__p.error"))),
            f"{side}_dag_hash": F.when(ok, payload.content_hash(F.col("__text"))), f"{side}_dag_ref": F.when(ok, blobs.reference(side, F.col("__text"))), f"{side}_dag_blob_bytes": F.when(ok, F.octet_length("__text").cast("long")),
            f"{side}_dag_depth": value("depth"), f"{side}_dag_num_qubits": value("n_qubits"), f"{side}_dag_num_clbits": value("n_clbits"), f"{side}_dag_op_nodes": value("size"), f"{side}_dag_twoq_ops": value("n_2q_gates"),
            f"{side}_dag_measure_ops": value("n_measure"), f"{side}_dag_layers": value("layers"), f"{side}_dag_gate_histogram": value("histogram"),
        })
        rows = rows.withColumn(f"{side}_dag_error_category", payload.error_category(F.col(f"{side}_dag_error"))).drop("__text", "__p")
    return quality.invalid_rows(rows, F.col("logical_dag_ok"), F.col("native_dag_ok"), policy)


def dag_blobs(rows: DataFrame) -> DataFrame:
    """The compressed texts that ``dags`` refers to, each once."""
    parts = [blobs.blobs(rows.where(F.coalesce(f"{side}_dag_ok", F.lit(False))), f"{c}_best_for_sim", side) for side, c in SIDES.items()]
    return parts[0].unionByName(parts[1])


def with_sensors(rows: DataFrame, sensors: DataFrame, order: list[Column] | None = None, keep: str = "first") -> DataFrame:
    """Sensor and calibration columns of each job."""
    return merge.merge_sensors(rows, sensors, merge.pick_key(rows.columns), "id", order, keep)


def filter_rows(rows: DataFrame, extra_drops: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Rows with a usable value on both sides, without debugging columns."""
    sides = {s: [f"{s}_dag_ok", f"hellinger_{s}", f"{s}_sim_status"] for s in SIDES}
    _, _, names = columns.drops(rows.columns, list(record_columns.DEFAULT_DROPS), list(extra_drops), [*record_columns.DEFAULT_KEEPS, *keep])
    return quality.both_sides(rows, sides["logical"], sides["native"]).select(*[F.col(quoted(n)) for n in names])


def clean(rows: DataFrame, zone: str = "Europe/Berlin", sparse: float = 0.01) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The typed data set, and what became of each column (column, action, reason).

    Jobs with a cancelled row go; columns are decided by name, then those that hold nothing useful are dropped; features
    and targets become numbers (anything else that stands there is an error), times become UTC.
    """
    kept = merge.drop_groups_with(rows, "parent_id", F.col("status") == "CANCELLED")
    decided = columns.decide(kept.columns, record_columns.family, record_columns.EXACT_ACTIONS)
    by = lambda *actions: [c for c, a, _ in decided if a in actions]
    numeric = [*by("feature"), *[c for c in ("hellinger_native", "hellinger_logical", "batch_size") if c in kept.columns]]
    quality.check_numbers(kept, numeric)
    gone = dict(quality.degenerate_columns(kept, by("feature"), exempt=list(columns.TIER3), sparse=sparse))
    decided = [(c, "drop", gone[c]) if c in gone else (c, a, r) for c, a, r in decided]
    out = []
    done = F.try_to_timestamp(F.col("timestamp_completed_utc").cast("string"))
    for c, action, _ in decided:
        if action == "drop":
            continue
        x = F.col(quoted(c))
        if c in ("hellinger_native", "hellinger_logical"):
            x = d.unit_interval(number(x))
        elif c in numeric:
            x = number(x)
        elif c == "timestamp_completed_utc":
            x = done
        elif c in ("timestamp_submitted", "timestamp_scheduled"):
            utc = times.to_utc(x.cast("string"), zone)
            out.append((times.not_after(utc, done) if c == "timestamp_scheduled" else utc).alias(f"{c}_utc"))
            continue
        out.append(x.alias(c))
    return kept.select(*out), decided


def build(jobs: DataFrame, sensors: DataFrame, seed: int = 42, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All stages up to the row filter."""
    rows = simulate(normalise(expand(spread(preprocess(jobs)))), seed)
    return filter_rows(with_sensors(dags(features(hellinger(verify_order(rows, cut=cut)))), sensors))
