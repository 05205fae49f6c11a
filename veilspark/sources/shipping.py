"""Lets Python workers import this package where it is not installed."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Puts the package's folder on the path of workers that are started from now on."""
    settings = spark.sparkContext.environment
    paths = [p for p in settings.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        settings["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
