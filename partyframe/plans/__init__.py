"""partyframe.plans: the registered queries, by the operator ids of the blueprint."""

from . import evaluation_queries, feature_queries, linkage_queries, model_queries, source_queries, study_queries
from .registry import ORACLES, QUERIES

#: Linked temporal parties: windows, aggregates and joins over a whole star schema.
flagship = QUERIES["J5_linked_temporal_parties"]

__all__ = ["ORACLES", "QUERIES", "evaluation_queries", "feature_queries", "flagship", "linkage_queries", "model_queries", "source_queries", "study_queries"]
