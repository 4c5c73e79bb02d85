"""Session settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join handling.

    On a cluster the master and the sizing come from spark-submit; `master` is for
    local runs.  Shuffle partitions start high and are coalesced at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # texts and vectors are wide: small batches keep a Python worker's memory flat
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        cores = os.cpu_count() or 4
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.default.parallelism", str(cores))
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

