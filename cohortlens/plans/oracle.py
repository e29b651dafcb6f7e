"""All check SQL, by query name."""

from __future__ import annotations

from cohortlens.plans import oracle_core, oracle_decide, oracle_jobs, oracle_stats

_MODULES = (oracle_core, oracle_decide, oracle_jobs, oracle_stats)


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out.update(module.sql())
    return out
