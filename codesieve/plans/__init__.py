"""Registered queries and their oracles."""


def load_registry():
    """Import every registry module; return (queries, oracles)."""
    from codesieve.plans import registry
    return registry.QUERIES, registry.ORACLES
