"""All queries of the core."""

from quernstone.queries import assembly, catalogue, evaluation, ingest, lifecycle, policies, search, texts

MODULES = (search, catalogue, evaluation, texts, lifecycle, policies, ingest, assembly)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLES
    return out
