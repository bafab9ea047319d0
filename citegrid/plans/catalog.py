"""The registry of named queries and their SQL oracles."""

from __future__ import annotations

from citegrid.plans import evidencing, identity, ledger, lifecycle, proposing, reconciling, similarity


def queries() -> dict:
    """Name -> callable(spark, sf_dir) for every registered query."""
    out: dict = {}
    for module in (similarity, identity, evidencing, ledger, lifecycle, proposing, reconciling):
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    out: dict[str, str] = {}
    for module in (similarity, identity, evidencing, ledger, lifecycle, proposing, reconciling):
        out |= module.ORACLES
    return out
