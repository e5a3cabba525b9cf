"""All queries of the core and the SQL that gives equal results."""

from __future__ import annotations

from tallyloom.plans import fixtures, integrity, media, problems, rendering, reports, texts, usage

MODULES = [problems, usage, reports, media, texts, fixtures, integrity, rendering]
FLAGSHIP = usage.usage_daily


def queries() -> dict:
    out = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in MODULES:
        out |= module.ORACLES
    return out
