"""Event-file sources (``compact_events``, ``fixed_events``) and small table files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hitframe.sources.compact import CompactEvents
from hitframe.sources.fixed import FixedEvents


def register(spark: SparkSession) -> None:
    """Make both event-file formats available to ``spark.read.format``."""
    spark.dataSource.register(CompactEvents)
    spark.dataSource.register(FixedEvents)
