"""All named queries over the reference operators, with their SQL."""

from __future__ import annotations

from trendloom.plans import answer, corpus, evidence, ledger, live, retrospect, space

_ALL = (evidence, answer, corpus, space, ledger, live, retrospect)


def queries() -> dict:
    return {name: fn for module in _ALL for name, (fn, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _ALL for name, (_, sql) in module.QUERIES.items() if sql}
