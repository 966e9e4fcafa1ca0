"""All queries of the library but those over texts."""

from viamark.plans import q_closures, q_driven, q_evaluation, q_layers, q_network, q_rasters, q_regions, q_roads, q_routing, q_streams, q_studies, q_tags, q_terrain, q_traces  # noqa: F401
from viamark.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
