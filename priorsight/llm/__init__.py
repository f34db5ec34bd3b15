"""Operators for preparing training data, each with its query over the shared tables.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from priorsight.llm import registry


def load_all() -> None:
    from priorsight.llm import grace_dedup, language_id, license_scan, mixing, near_dedup, nearest_blocks, periodic_runs, pivot_search, quality, sentence_pieces, substring_dedup, token_alignment, url_filters  # noqa: F401


def queries() -> dict:
    load_all()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    load_all()
    return dict(registry.ORACLES)
