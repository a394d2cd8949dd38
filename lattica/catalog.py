"""All registered queries over the test tables, with equivalent SQL."""

from __future__ import annotations

from lattica.plans import models, more, records, relations

FLAGSHIP = "replicate_stats"
_PLANS = {**records.Q, **relations.Q, **more.Q, **models.Q}


def queries():
    return {n: f for n, (f, _) in _PLANS.items()}


def oracle_sql():
    return {n: sql for n, (_, sql) in _PLANS.items() if sql}
