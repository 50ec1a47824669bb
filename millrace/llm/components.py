"""Connected components with rounds kept in an operator's scratch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm.scratch import Scratch
from millrace.plans import components as plans


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge; see ``millrace.plans.components``."""
    return plans.components(edges, lambda df: scratch.keep(df, "round"), scratch.drop, max_rounds)
