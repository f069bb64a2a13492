"""All queries of the core and the SQL they are held against."""

from __future__ import annotations

from corvane.plans import analytics, records, reports  # noqa: F401  (reports adds to the queries of analytics)

QUERIES = {**analytics.QUERIES, **records.QUERIES}
ORACLES = {**analytics.ORACLES, **records.ORACLES}
