"""SparkSession settings for the reports.

Adaptive execution re-plans joins and coalesces the many small shuffle
partitions these aggregations produce; skew-join handling splits skewed
join partitions. A larger compiled-code cache keeps the generated classes
of all reports across runs. The UI stays off. The session time zone is left
as configured: it decides the day of a TIMESTAMP ``date`` when it is cast.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the reports compile many distinct whole-stage classes; the default
    # cache of 100 compiled classes evicts them between reports and forces
    # recompilation (static: takes effect when the session is created)
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(master: str | None = None, app: str = "cohortwise", conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

