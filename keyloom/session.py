"""Session defaults shared by the bench, the tests and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every operator expects; a cluster's own settings win where they are already present.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "keyloom", master: str | None = None, **conf: str) -> SparkSession:
    """An active session with DEFAULTS, or a new one on `master`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
