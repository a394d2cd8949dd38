"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
gather what the operator modules register.
"""


def queries():
    from lattica.llm import registry

    return registry.queries()


def oracle_sql():
    from lattica.llm import registry

    return registry.oracle_sql()
