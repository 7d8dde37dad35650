"""Driver-table bindings, registered queries and their SQL oracles."""

from scenequality.plans import (  # noqa: F401
    agreement_queries, answer_queries, file_queries, panel_queries, record_queries, scene_queries, study_queries)
from scenequality.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
