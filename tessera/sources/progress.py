"""Progress of a run: what each stage wrote and how long it took, as rows with times.

A stage is written to the shared folder once, and counted while it is written (``observe``), so progress costs no pass of
its own. Events are rows (n, kind, step, at, lapse_ms, key, value); their lines are ``kind;n;lapse;key;value``.

Defined cases: a stage without rows has events with 0; a stage that fails has its begin only; names may repeat.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import csv_line
from tessera.staging import written

SCHEMA = "n int, kind string, step string, at timestamp, lapse_ms long, key string, value long"


class Progress:
    """The events of one run; ``stage`` writes a table and gives it back, read from what was written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.begun = time.monotonic()
        self.rows: list[tuple] = []

    def _note(self, kind: str, step: str, key: str | None = None, value: int | None = None) -> None:
        now = datetime.now(timezone.utc)
        self.rows.append((len(self.rows), kind, step, now, int((time.monotonic() - self.begun) * 1000), key, value))

    def stage(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        """``df`` written and read back; its rows, and the aggregates ``counts`` over it, become events."""
        seen = Observation()
        self._note("begin", step)
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("long").alias(name) for name, c in counts.items()]), "stage")
        for key, value in seen.get.items():
            self._note("count", step, key, int(value or 0))
        self._note("end", step)
        return out

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def lines(self) -> DataFrame:
        """The events as lines, in order."""
        line = csv_line([F.col(c) for c in ("kind", "n", "lapse_ms", "key", "value")])
        return self.events().orderBy("n").select(line.alias("line"))
