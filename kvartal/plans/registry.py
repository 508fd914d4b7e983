"""All queries of the core, and the SQL they are compared with."""

from __future__ import annotations

from kvartal.plans import general, lookups, matching, scalar, stores

QUERIES = {**general.QUERIES, **scalar.QUERIES, **matching.QUERIES, **lookups.QUERIES, **stores.QUERIES}
SQL: dict[str, str] = {**general.SQL, **scalar.SQL, **matching.SQL, **lookups.SQL, **stores.SQL}
FLAGSHIP = "p6_found"
