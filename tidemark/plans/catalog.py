"""The engine's queries, by name, and the SQL that each must agree with."""

from __future__ import annotations

from . import market, streams, sql


def queries() -> dict:
    return dict(market.QUERIES) | dict(streams.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
