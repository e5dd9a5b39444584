"""Registry of the catalogue queries: each has a name, a Spark plan and, where SQL can express it, an oracle.

A query takes (spark, sf_dir) and runs over whole tables.  Importing this module registers all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The inventory's operators that each query exercises.
COVERS: dict[str, str] = {}


def query(covers: str, oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


#: Queries that fit models, which a fast run leaves out.
NEEDS_MODEL = {"gbt_tier_ablation", "leave_one_device_out", "feature_importance", "cross_validation", "repeated_splits", "restricted_robustness", "window_ablation", "class_shift_of_tiers", "permutation_importance", "tier1_models", "device_transfer", "tree_shapley_importance"}


def chosen(only: list[str] = (), fast: bool = False) -> list[str]:
    """Names of the queries to run, in order; an unknown name is an error."""
    if unknown := [n for n in only if n not in QUERIES]:
        raise ValueError(f"no query {', '.join(unknown)}")
    return [n for n in QUERIES if (not only or n in only) and not (fast and n in NEEDS_MODEL)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import alignment, cohort_queries, distribution_queries, model_queries, payload_queries, program_queries, record_queries, source_queries, statistics_queries, table_queries  # noqa: E402, F401
