"""Flags, data set resolution, default lists and feature tiers: no table tells them, so no query does."""

import pytest

from telemill.operators import columns, record_columns
from telemill.plans import catalog
from telemill.sources import io


def test_data_set_resolution(monkeypatch):
    monkeypatch.delenv(io.DATASET_VARIABLE, raising=False)
    assert io.resolve_dataset(["/nowhere/at/all.parquet"], "default.parquet") == "default.parquet"
    monkeypatch.setenv(io.DATASET_VARIABLE, "here/data.parquet")
    assert io.resolve_dataset(["/nowhere/at/all.parquet"], "default.parquet") == "here/data.parquet"


def test_flags():
    a = io.arguments("--pool poolB --results out --seed 7 --fast --only a b --windows 300=a 120=b".split())
    assert (a["folder"], a["seed"], a["only"], a["fast"], list(a["windows"].items())) == ("out_poolB", 7, ["a", "b"], True, [(120, "b"), (300, "a")])
    with pytest.raises(ValueError):
        io.window_paths(["ten=x"])


def test_queries_that_fit_models_are_left_out_of_fast_runs():
    some = ["gbt_tier_ablation", "leave_one_device_out", "row_counts"]
    assert [n for n in catalog.chosen(only=some) if n not in catalog.chosen(fast=True)] and "row_counts" in catalog.chosen(fast=True)
    assert catalog.NEEDS_MODEL <= set(catalog.QUERIES)


def test_default_lists_and_tiers():
    sides = ("logical", "native")
    have = ["id", "parent_id", "shots", "status", "circuit", "result", "owner", *record_columns.DAG_KEEPS, *record_columns.DECOMPOSITION_KEEPS, *[f"{s}_dag_error" for s in sides], "row_drop_reason"]
    present, _, kept = columns.drops(have, list(record_columns.DEFAULT_DROPS), [], list(record_columns.DEFAULT_KEEPS))
    assert kept == ["id", "parent_id", "shots", "status", *record_columns.DAG_KEEPS, *record_columns.DECOMPOSITION_KEEPS]
    dropped = columns.drop_set(have, ["result", "absent"], ["circuit"], ["owner", "row_drop_reason", "shots"], protected=["shots"], keep=["id"])
    assert {c for c in dropped if c in present} == {"circuit", "result", "owner", "row_drop_reason"}
    assert set(columns.TIER1) - set(columns.TIER3) == {"device_encoded"} and "shots" in columns.TIER3
    assert columns.release_name("id", False, {"id": "job_id"}) == "job_id" and columns.release_name("native_depth", True, {"native_depth": "x"}) == "native_depth"


def test_selectors():
    assert io.select_value('{"a": {"b": [1, 2]}}', "a.b.1") == 2
    for absent in ("a.c", "a.b.7", "x", "a.b.1.z"):
        assert io.select_value('{"a": {"b": [1, 2]}}', absent) is None
    assert io.select_value("k,v\nx,1\ny,\n", "v|k=x") == 1.0
    assert io.select_value("k,v\nx,1\ny,\n", "v|k=y") is None is io.select_value("k,v\nx,1\n", "w|k=x")
