"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from kgspark import fixed

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: Optional[str] = None):
    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            # Identifier formats are written once, in `fixed`.
            ORACLES[name] = (
                sql.replace("@NODE@", fixed.NODE_RID_PREFIX).replace("@NET@", fixed.NETWORK_RID_PREFIX)
                .replace("@ENTITY@", fixed.ENTITY_URI_PREFIX)
            )
        return fn

    return register
