import json

import pytest

from telemill.operators import record_columns
from telemill.plans import stages

BELL = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[2]; creg c[2]; h q[0]; cx q[0],q[1]; measure q -> c;'
ONE = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[2]; creg c[2]; x q[0]; measure q -> c;'
COLUMNS = "id string, executed_resource string, status string, shots string, circuit string, executed_circuit string, result string, timestamp_submitted string, timestamp_scheduled string, timestamp_completed string, timestamp_completed_utc string, owner string, budget string"
TIMES = ("2025-07-01 10:00:00", "2025-07-01 12:00:05", "2025-07-01 12:00:00", "2025-07-01 10:00:00Z", "o", "b")


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [
        ("1", "dev", "COMPLETED", "1000", json.dumps([ONE, BELL]), json.dumps([ONE, BELL]), json.dumps([{"10": 1000}, {"00": 490, "11": 510}]), *TIMES),
        ("2", "dev", "COMPLETED", "1000", ONE, ONE, '{"1 0": 900, "00": 100}', *TIMES),
        ("3", "dev", "CANCELLED", "10", ONE, ONE, '{"01": 10}', *TIMES),
        ("4", "", "COMPLETED", "10", ONE, ONE, '{"01": 10}', *TIMES),
        ("5", "dev", "COMPLETED", "10", "junk", ONE, '{"01": 10}', *TIMES),
        ("6", "dev", "COMPLETED", "10", json.dumps([ONE, BELL, ONE]), json.dumps([ONE, BELL]), None, *TIMES),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def built(spark, jobs):
    rows = stages.simulate(stages.normalise(stages.expand(stages.preprocess(jobs))))
    return stages.dags(stages.features(stages.hellinger(stages.verify_order(rows)))).cache()


def test_rows_and_order(built):
    got = {r.sub_id: r for r in built.collect()}
    assert set(got) == {"1_0", "1_1", "2_0", "3_0", "5_0", "6_0"}
    assert got["1_0"].logical_best_endianness_raw == "reversed" and got["1_0"].result_aligned_logical == '{"01":1000}'
    # Bell states read the same both ways: decided by what dominates.
    assert got["1_1"].logical_best_endianness_raw == "uncertain" and got["1_1"].logical_best_endianness == "reversed" and got["1_1"].logical_endianness_used_fallback
    assert got["1_0"].hellinger_logical == pytest.approx(0, abs=1e-9) and got["1_1"].hellinger_native < 0.1
    assert got["2_0"].hellinger_native == pytest.approx((1 - 0.9**0.5) ** 0.5)
    assert got["5_0"].hellinger_logical is None and got["5_0"].hellinger_native is not None and got["5_0"].feature_error.startswith("logical")
    assert got["6_0"].batch_len_mismatch_circuit_vs_executed_vs_result and got["6_0"].hellinger_native_error


def test_structure_and_addresses(built):
    got = {r.sub_id: r for r in built.collect()}
    assert (got["1_1"].logical_depth, got["1_1"].native_n_2q_gates, got["1_1"].delta_depth, got["1_1"].ratio_depth) == (3, 1, 0, 1)
    assert got["1_0"].logical_dag_hash == got["2_0"].logical_dag_hash != got["1_1"].logical_dag_hash
    assert got["5_0"].row_drop_reason == "logical_failed" and got["5_0"].logical_dag_error_category
    assert stages.dag_blobs(built).count() == 4


def test_build_and_clean(spark, jobs):
    sensors = spark.createDataFrame([("1", "x", 1.0, 2), ("2", "y", 3.0, 2), ("3", "z", 5.0, 2)], "id string, status string, sc_t__mean double, sc_t__count int")
    out = stages.build(jobs, sensors)
    assert not set(out.columns) & {"circuit", "owner", "feature_error", "sensor_source_id"} and "logical_dag_ref" in out.columns
    assert {r.sub_id for r in out.select("sub_id").collect()} >= {"1_0", "1_1", "2_0"}
    final, decided = stages.clean(out, sparse=0.0)
    rows = {r.sub_id: r for r in final.collect()}
    assert "3_0" not in rows and rows["2_0"].sc_t__mean == 3.0 and "sc_t__count" not in final.columns
    assert final.schema["hellinger_native"].dataType.typeName() == "double"
    assert str(rows["2_0"].timestamp_submitted_utc).startswith("2025-07-01 08:00") and rows["2_0"].timestamp_scheduled_utc is None
    assert dict((c, a) for c, a, _ in decided)["logical_dag_ref"] == "drop"


def test_default_lists():
    assert len(record_columns.DEFAULT_DROPS) == len(set(record_columns.DEFAULT_DROPS)) == 90
    assert (len(record_columns.DAG_KEEPS), len(record_columns.PROTECTED_COLUMNS)) == (24, 17)


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("sc_t__mean", "feature"), ("sc_t__count", "drop"), ("x__y__fallback_used", "drop"), ("__mean", None), ("QB12_t1_time", "feature"), ("QB1_frequency", "drop"), ("QB1_new", None), ("QBx_t1_time", None),
        ("TC_1_2_cz_gate_fidelity", "drop"), ("TC_1_cz_gate_fidelity", None), ("readout_error_QB3", "drop"), ("readout_error_3", None), ("native_dag_ref", "drop"), ("ratio_depth", "drop"), ("delta", None), ("other_depth", None),
    ],
)
def test_names_are_read_by_their_parts(name, wanted):
    found = record_columns.family(name)
    assert (found and found[0]) == wanted


def test_jobs_of_one_small_file_go_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "JOBS", 10)
    spark.range(95).coalesce(1).write.parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    out = stages.spread(jobs)
    assert jobs.rdd.getNumPartitions() == 1 and out.rdd.getNumPartitions() == 10
    assert sorted(r.id for r in out.collect()) == list(range(95))
