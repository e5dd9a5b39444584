"""Names of execution records' columns: what the final stages drop and keep by default, and how the final data set's
columns are decided: by name, else by the parts of which the name is made."""

from __future__ import annotations

from dataclasses import dataclass

from .columns import CHANNEL_STATISTICS

# Column names of the record format.
PAYLOAD_COLUMNS = tuple("""
circuit executed_circuit circuit_qasm2_norm executed_circuit_qasm2_norm executed_circuit_qasm2_norm_stripped circuit_best_for_sim executed_circuit_best_for_sim
circuit_norm_text executed_circuit_norm_text result result_expanded ideal_result_logical ideal_result_native result_aligned_logical result_aligned_native
""".split())
PARSE_COLUMNS = tuple("""
circuit_parse_error executed_circuit_parse_error result_parse_error ideal_result_logical_error ideal_result_native_error circuit_format executed_circuit_format
circuit_parse_ok executed_circuit_parse_ok circuit_kind executed_circuit_kind circuit_n executed_circuit_n circuit_source_syntax executed_circuit_source_syntax
circuit_parser_used executed_circuit_parser_used circuit_norm_format executed_circuit_norm_format circuit_best_for_sim_format executed_circuit_best_for_sim_format
result_kind result_n batch_len_mismatch_circuit_vs_executed_vs_result
""".split())
BATCH_COLUMNS = tuple("""
circuit_batch_raw_kind circuit_batch_raw_n circuit_batch_raw_error executed_circuit_batch_raw_kind executed_circuit_batch_raw_n executed_circuit_batch_raw_error
result_batch_raw_kind result_batch_raw_n result_batch_raw_error
""".split())
CHECK_COLUMNS = tuple("""
logical_num_qubits native_num_qubits logical_sim_status native_sim_status logical_verify_status logical_verify_error logical_best_endianness_raw logical_best_endianness
logical_endianness_confident logical_endianness_used_fallback native_verify_status native_verify_error native_best_endianness_raw native_best_endianness
native_endianness_confident native_endianness_used_fallback hellinger_logical_mode_used hellinger_native_mode_used hellinger_logical_result_source
hellinger_native_result_source hellinger_logical_error hellinger_native_error feature_error
""".split())
DAG_DEBUG_COLUMNS = tuple("""
logical_dag_source_col logical_dag_attempts logical_dag_used_fallback logical_dag_error_category logical_dag_error native_dag_source_col native_dag_attempts
native_dag_used_fallback native_dag_error_category native_dag_error row_drop_reason
""".split())
AUDIT_COLUMNS = tuple("sensor_source_id owner budget calibration_target_time_utc calibration_query_start_utc calibration_query_end_utc calibration_status calibration_resource_used".split())
DAG_METRICS = tuple("ok ref hash blob_bytes depth num_qubits num_clbits op_nodes twoq_ops measure_ops layers gate_histogram".split())
PROTECTED_COLUMNS = tuple("""
id parent_id sub_id batch_index batch_size is_batch_job executed_resource timestamp_scheduled timestamp_scheduled_utc timestamp_completed timestamp_completed_utc
window_start_utc window_end_utc status shots sensor_merge_found calibration_time_delta_seconds
""".split())
#: What becomes of single columns in the final data set.
EXACT_ACTIONS = {
    "hellinger_native": "target",
    "parent_id": "id",
    "sub_id": "id",
    "executed_resource": "id",
    "timestamp_completed_utc": "id",
    "hellinger_logical": "meta",
    "id": "meta",
    "status": "meta",
    "sensor_merge_found": "drop",
    "batch_index": "drop",
    "batch_size": "meta",
    "is_batch_job": "drop",
    "timestamp_completed": "drop",
    "timestamp_submitted": "meta",
    "timestamp_scheduled": "meta",
    "window_start_utc": "drop",
    "window_end_utc": "drop",
    "calibration_window_start_utc": "drop",
    "calibration_window_end_utc": "drop",
    "calibration_sample_ts_utc": "drop",
}
#: What becomes of calibration metrics, of qubits (QB<n>) and of couplers (TC_<i>_<j>).
CALIBRATION_ACTIONS = {
    ("qubit", "t1_time"): "feature",
    ("qubit", "t2_time"): "feature",
    ("qubit", "t2_echo_time"): "feature",
    ("qubit", "error_0_1"): "feature",
    ("qubit", "error_1_0"): "feature",
    ("qubit", "anharmonicity"): "drop",
    ("qubit", "frequency"): "drop",
    ("qubit", "fidelity_1qb_cliffords_xy"): "drop",
    ("qubit", "fidelity_1qb_gates_averaged"): "drop",
    ("qubit", "single_shot_readout_fidelity"): "drop",
    ("qubit", "readout_error"): "drop",
    ("coupler", "cz_gate_fidelity"): "drop",
    ("coupler", "fidelity_2qb_cliffords_averaged"): "drop",
}
# End of fixed values.

SIDES = ("logical", "native")
#: Statistics of a window that only tell how it was filled.
WINDOW_COUNTERS = ("count", "fallback_used")
DEFAULT_DROPS = PAYLOAD_COLUMNS + PARSE_COLUMNS + BATCH_COLUMNS + CHECK_COLUMNS + DAG_DEBUG_COLUMNS + AUDIT_COLUMNS
DAG_KEEPS = tuple(f"{side}_dag_{m}" for side in SIDES for m in DAG_METRICS)
DECOMPOSITION_KEEPS = tuple(f"{side}_depth_{when}_decompose" for side in SIDES for when in ("before", "after"))
DEFAULT_KEEPS = (*PROTECTED_COLUMNS, *DAG_KEEPS, *DECOMPOSITION_KEEPS)


@dataclass(frozen=True)
class Name:
    """A column's name, read: whose value it holds, which, and by which statistic of a window.

    Owners are ``channel`` (a sensor's), ``qubit``, ``coupler``, and of program structure ``logical``, ``native``,
    ``delta`` and ``ratio``.
    """

    owner: str
    metric: str
    statistic: str | None = None


def read(name: str) -> Name | None:
    """A name of the families that a record has, by its parts between underscores; None for others."""
    channel, sep, statistic = name.rpartition("__")
    if sep and channel and statistic in CHANNEL_STATISTICS:
        return Name("channel", channel, statistic)
    parts = name.split("_")
    head, rest = parts[0], "_".join(parts[1:])
    numbered = lambda part: part[:2] == "QB" and part[2:].isdigit()
    if numbered(head):
        return Name("qubit", rest)
    if numbered(parts[-1]) and parts[:-1] == ["readout", "error"]:
        return Name("qubit", "readout_error")
    if head == "TC" and len(parts) > 3 and parts[1].isdigit() and parts[2].isdigit():
        return Name("coupler", "_".join(parts[3:]))
    if head in (*SIDES, "delta", "ratio") and len(parts) > 1:
        return Name(head, rest)
    return None


def family(name: str) -> tuple[str, str] | None:
    """(action, reason) for a name that isn't decided alone; None if it belongs to no family."""
    n = read(name)
    if n is None:
        return None
    if n.owner == "channel":
        return ("drop", "tells how a window was filled") if n.statistic in WINDOW_COUNTERS else ("feature", "statistic of a sensor's window")
    if n.owner in ("qubit", "coupler"):
        action = CALIBRATION_ACTIONS.get((n.owner, n.metric))
        return action and (action, "calibration metric")
    return "drop", "where a program is stored" if n.metric.startswith("dag_") else "structure that isn't a chosen feature"
