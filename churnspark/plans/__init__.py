"""Named queries over the warehouse tables, each next to its check SQL."""

from importlib import import_module

from churnspark.plans.registry import QUERIES

MODULES = ("profile", "scoring", "graph", "corpus", "retrieval", "evaluation", "streaming")


def load_queries():
    """Import every query module and return the registry."""
    for module in MODULES:
        import_module(f"churnspark.plans.{module}")
    return dict(QUERIES)
