"""Operators of a training-data pipeline, and their registered queries."""


def load_all():
    """Import the queries and return ``(queries, oracles)``."""
    from lacuna.llm import queries, registry  # noqa: F401

    return registry.QUERIES, registry.ORACLES
