"""A Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Needed for results: times in UTC.  The rest is Spark's own advice for its size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a Python worker has one core: more threads of a numeric library only contend for it
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or one with SETTINGS; keyword names have dots as double underscores."""
    builder = SparkSession.builder.appName("glasswort")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
