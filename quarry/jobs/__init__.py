"""Registered queries over the given tables and their SQL."""

from __future__ import annotations

from quarry.jobs import answers, catalogue, evidence, exporting, extraction, indexing, ingest, kb, live, monitor, papers, reports, routes, sessions, streams, vectors  # noqa: F401  (each registers its queries)


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
