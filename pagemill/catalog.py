"""All queries over the driver tables, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from .plans import assembly, layout_plans, matching_plans, registry, render_plans, rule_plans, semantic_plans, source_plans, structure_plans, text_plans, validation_plans, viewer_plans, work_plans  # noqa: F401


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
