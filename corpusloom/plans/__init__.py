"""All registered queries; importing this package registers them."""

from corpusloom.plans import assembly_queries, cleaning_queries, graph_queries, retrieval_queries, service_queries, text_queries  # noqa: F401
from corpusloom.registry import REGISTRY

__all__ = ["REGISTRY"]
