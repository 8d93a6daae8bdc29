"""All registered queries of the annotation engine."""

from __future__ import annotations

from . import dataset, evaluation, exchange


def queries() -> dict:
    return {f.__name__: f for f in (*evaluation.QUERIES, *dataset.QUERIES, *exchange.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return evaluation.SQL | dataset.SQL | exchange.SQL
