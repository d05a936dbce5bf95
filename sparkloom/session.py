"""Sessions with named behaviour profiles."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of each profile.
PROFILES = {
    "3.5": {"spark.sql.ansi.enabled": "false", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"},
    "4.0": {"spark.sql.ansi.enabled": "true"},
}
#: Settings for large inputs: sizes follow the data, skewed joins are split.
SCALE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "sparkloom", profile: str = "4.0", **settings: str) -> SparkSession:
    """Get or make a session with a profile; settings given by name (dots as __) come last."""
    builder = SparkSession.builder.appName(name)
    for k, v in {**SCALE, **PROFILES[profile], **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def apply_profile(spark: SparkSession, profile: str) -> None:
    """Switch a running session to a profile."""
    for settings in PROFILES.values():
        for k in settings:
            spark.conf.unset(k)
    for k, v in PROFILES[profile].items():
        spark.conf.set(k, v)
