"""Subscription renewal and A/B training-funnel analytics as Spark DataFrame plans.

Layout:
    functions/  fixed rule tables and per-row Column expressions
    sources/    schemas, event-table readers, test-data mappings
    operators/  the reusable steps (base orders, renewal flags, counts, pivots)
    plans/      the five reports, the query registry and plan checks
"""

__all__ = ["functions", "sources", "operators", "plans"]
