"""Settings from the session's configuration (spark.offerlens.*) or the environment (OFFERLENS_*). Credentials have no place here."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    model: str = "stand-in"
    threshold: float = 50.0
    interval: str = "300 seconds"
    feed_head: int = 10

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The session's value goes before the environment's, that before the default. A value of the wrong type raises."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.offerlens.{f.name}", None) or os.environ.get(f"OFFERLENS_{f.name.upper()}")
            if text is not None:
                found[f.name] = type(f.default)(text)
        return cls(**found)
