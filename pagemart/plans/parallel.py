"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer tasks than the session has cores.

    Meant for small files ahead of per-row Python work. A large scan already has more tasks
    than cores and passes through without a shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
