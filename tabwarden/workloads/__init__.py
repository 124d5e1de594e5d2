"""Registered queries on the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from tabwarden.workloads.base import Query


def all_queries() -> dict[str, Query]:
    from tabwarden.workloads import catalog, checks, dictionaries, folders, houses, primary, streams

    merged: dict[str, Query] = {}
    for module in (checks, dictionaries, primary, catalog, folders, streams, houses):
        merged.update(module.QUERIES)
    return merged
