"""Name -> query callable and name -> oracle SQL, merged from the plan modules."""

from __future__ import annotations

from varietas.plans import (clean_plans, embedding_plans, sampling_plans, source_plans, stats_plans,
                            suite_plans, sweep_plans, topic_plans)

_MODULES = [sampling_plans, embedding_plans, stats_plans, topic_plans, sweep_plans, suite_plans, clean_plans, source_plans]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
