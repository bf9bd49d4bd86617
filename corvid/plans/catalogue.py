"""All of the library's queries, gathered for the driver contract."""

from __future__ import annotations

from corvid.plans import page_queries, register_queries, report_queries, retrieval_queries, structure_queries, text_queries  # noqa: F401  each registers its queries
from corvid.plans.queries import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark, sf_dir):
    """From question variants to evidence."""
    return retrieval_queries.search_evidence(spark, sf_dir)
