"""Deciding by name what happens to columns: rules, groups, devices, and checks of feature lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ("target", "id", "meta", "feature", "drop")
#: Statistics that end channel names, and the grammar of column names.
CHANNEL_STATISTICS = ("mean", "min", "max", "sd", "value", "count", "fallback_used")
CHANNEL = re.compile(rf"^(?P<channel>.+)__(?P<statistic>{'|'.join(CHANNEL_STATISTICS)})$")
CALIBRATION = re.compile(r"^(QB\d+|TC_\d+_\d+)_\w+$")
CIRCUIT = re.compile(r"^(logical|native|delta|ratio)_\w+$")
DEVICE_PREFIXES = {"superconducting": ("sc_",), "trapped ion": ("ion_",)}
CIRCUIT_METRICS = ("n_qubits", "n_clbits", "depth", "size", "n_1q_gates", "n_2q_gates", "n_measure", "twoq_ratio", "connectedness", "liveliness")
TIER3 = tuple(f"{side}_{m}" for side in ("logical", "native") for m in CIRCUIT_METRICS) + ("shots",)
TIER1 = (*TIER3, "device_encoded")


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    action: str
    reason: str


DEFAULT_RULES = (
    Rule(re.compile(r"^hellinger_(logical|native)$"), "target", "distance to the ideal distribution"),
    Rule(re.compile(r"^(job_id|circuit_id|id|parent_id|sub_id)$"), "id", "identifier"),
    Rule(re.compile(r"^(status|device|executed_resource|batch_\w+|timestamp_\w+|\w+_hour_utc|window_\w+)$"), "meta", "bookkeeping"),
    Rule(re.compile(r"^.+__(count|fallback_used)$"), "drop", "bookkeeping of a window"),
    Rule(CHANNEL, "feature", "sensor channel"),
    Rule(CALIBRATION, "feature", "calibration"),
    Rule(re.compile(r"^(delta|ratio)_\w+$"), "drop", "follows from other columns"),
    Rule(CIRCUIT, "feature", "program structure"),
)


def by_rules(name: str, rules=DEFAULT_RULES) -> tuple[str, str] | None:
    """(action, reason) of the first rule that a name matches."""
    return next(((r.action, r.reason) for r in rules if r.pattern.match(name)), None)


def decide(columns: list[str], family: Callable[[str], tuple[str, str] | None] = by_rules, exact: dict[str, str] | None = None, features: tuple[str, ...] = TIER3) -> list[tuple[str, str, str]]:
    """(column, action, reason): listed features, then exact names, then by family; a name that nothing decides is an error."""
    out, unknown = [], []
    for c in columns:
        if c in features:
            out.append((c, "feature", "program structure"))
        elif exact and c in exact:
            out.append((c, exact[c], "named"))
        elif found := family(c):
            out.append((c, *found))
        else:
            unknown.append(c)
    if unknown:
        raise ValueError(f"no rule for columns: {', '.join(unknown)}")
    return out


def decisions(spark: SparkSession, columns: list[str], **kwargs) -> DataFrame:
    return spark.createDataFrame(decide(columns, **kwargs), "column string, action string, reason string")


def drops(columns: list[str], unwanted: list[str], extra: list[str] = (), keep: list[str] = ()) -> tuple[list[str], list[str], list[str]]:
    """(names to drop that exist, names that don't, what is left in order); ``keep`` wins."""
    wanted = [c for c in dict.fromkeys([*unwanted, *extra]) if c not in set(keep)]
    present = [c for c in wanted if c in set(columns)]
    return present, [c for c in wanted if c not in set(columns)], [c for c in dict.fromkeys(columns) if c not in set(present)]


#: Groups of the published columns, by name.
GROUPS = (
    ("identifier", r"^(job_id|circuit_id|device)$"),
    ("time", r"_hour_utc$|^timestamp_"),
    ("job", r"^(status|batch_size|shots)$"),
    ("target", r"^hellinger_"),
    ("calibration", r"^sc_cal_|^QB\d+_|^TC_\d+_"),
    ("sensor", r"^(sc|ion)_|__(mean|min|max|sd|value)$"),
    ("circuit", r"^(logical|native)_"),
)


def group_of(column: str) -> str:
    return next((g for g, p in GROUPS if re.search(p, column)), "other")


#: Prefixes of sensor channels and their categories.
SENSOR_CATEGORIES = {"sc_cryo_": "cryostat", "sc_cooling_": "cooling water", "sc_gas_": "gas handling", "ion_lab_": "laboratory", "ion_trap_": "trap", "ion_laser_": "laser", "sc_room_": "room"}


def sensor_category(c: Column) -> Column:
    out = F.lit("other")
    for prefix, name in reversed(SENSOR_CATEGORIES.items()):
        out = F.when(c.startswith(prefix), name).otherwise(out)
    return out


def sensor_name(path: Column) -> Column:
    return F.lower(F.translate(F.replace(path, F.lit("/"), F.lit("__")), "-.", "__"))


def calibration_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "_")


def release_name(column: str, published: bool, names: dict[str, str] | None = None) -> str:
    """The name under which a column is published: its own in a published data set, else that of the mapping."""
    return column if published else (names or {}).get(column, column)


def drop_set(columns: list[str], results: list[str], programs: list[str], extra: list[str] = (), protected: list[str] = (), keep: list[str] = ()) -> list[str]:
    """Result, program and extra columns that are there, less protected and kept ones, in the order of the columns."""
    unwanted = {*results, *programs, *extra} - {*protected, *keep}
    return [c for c in columns if c in unwanted]


def device_features(columns: list[str], device: str, base: tuple[str, ...] = TIER3, prefixes: dict[str, tuple[str, ...]] = DEVICE_PREFIXES) -> list[str]:
    """Program columns that are there, then the device's own sensor and calibration columns."""
    sensors, calibration = device_columns(columns, device, prefixes)
    return [*[c for c in base if c in columns], *sensors, *calibration]


def device_columns(columns: list[str], device: str, prefixes: dict[str, tuple[str, ...]] = DEVICE_PREFIXES) -> tuple[list[str], list[str]]:
    """(sensor, calibration) columns of a device, by prefix."""
    own = [c for c in columns if c.startswith(prefixes[device])]
    return [c for c in own if not c.startswith("sc_cal_")], [c for c in own if c.startswith("sc_cal_")]


def manifest_columns(columns: list[str], names: list[str], statistics: tuple[str, ...] = ("mean", "min", "max", "sd", "value"), ignore_case: bool = True) -> list[str]:
    """Columns whose channel a manifest lists: sensors whatever their case, calibration exactly."""
    fold = str.lower if ignore_case else str
    wanted = {fold(n) for n in names}
    channel = lambda c: c.rsplit("__", 1)[0] if c.rsplit("__", 1)[-1] in statistics else c
    return [c for c in columns if fold(channel(c)) in wanted]


def common_columns(schemas: list[list[str]]) -> list[str]:
    """What all have, in the order of the first."""
    rest = [set(s) for s in schemas[1:]]
    return [c for c in schemas[0] if all(c in s for s in rest)]


def check_no_leakage(device: str, features: list[str], columns: list[str], prefixes: dict[str, tuple[str, ...]] = DEVICE_PREFIXES) -> None:
    """Features must not be another device's columns."""
    foreign = {c for d in prefixes if d != device for part in device_columns(columns, d, prefixes) for c in part}
    if bad := sorted((foreign - {c for part in device_columns(columns, device, prefixes) for c in part}) & set(features)):
        raise ValueError(f"features of another device than {device}: {', '.join(bad)}")


def check_no_metadata(features: list[str]) -> None:
    bad = [f for f in features if f not in TIER1 and any(r.action in ("id", "meta", "target") and r.pattern.match(f) for r in DEFAULT_RULES)]
    if bad:
        raise ValueError(f"metadata among the features: {', '.join(bad)}")
