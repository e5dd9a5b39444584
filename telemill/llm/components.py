"""Connected components with intermediate results in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from telemill.operators import graphs

from .workspace import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge; see ``graphs.components``."""
    return graphs.components(edges, lambda df: materialise(df, name))
