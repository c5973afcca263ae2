"""Figures gathered by the job that writes a table, so that no further scan is
needed for them.

Spark merges the figures of tasks as they finish, each partition's once: a
task that is retried or run twice does not change them.  They belong to one
write, made without a shuffle behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


class Figures:
    """``Figures(df, name=aggregate, ...)``: write ``.data``, then ask ``.get()``."""

    def __init__(self, df: DataFrame, **figures: Column):
        self._seen = Observation()
        self.data = df.observe(self._seen, *[c.alias(name) for name, c in figures.items()])

    def get(self) -> dict:
        return dict(self._seen.get)
