"""Registered queries over the given tables, and the SQL that checks them."""


def load():
    """The registry with every query module imported."""
    from catalog import q_estate, q_forms, q_parity, q_retail, q_semantics, q_tables, registry  # noqa: F401

    return registry
