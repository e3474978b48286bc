"""All registered queries and their SQL twins."""

from ticketloom.catalog import comparisons, messages, models, operations, profiles, retrieval, streams, vectors

MODULES = (messages, profiles, models, vectors, comparisons, streams, retrieval, operations)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
