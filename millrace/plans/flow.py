"""Flow: datasets and the sinks they go to, run together."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from millrace.dataset import Dataset
from millrace.sources.writers import Sink


class Flow:
    """A named set of outputs.  Nothing runs before execute(); each output is one Spark query."""

    def __init__(self, spark: SparkSession, name: str = "flow", settings: dict[str, str] | None = None):
        self.spark, self.name, self.settings = spark, name, dict(settings or {})
        self.outputs: list[tuple[Dataset, Sink]] = []

    def nested(self, prefix: str) -> dict[str, str]:
        """The settings under a prefix, without it."""
        return {k[len(prefix) + 1 :]: v for k, v in self.settings.items() if k.startswith(prefix + ".")}

    def persist(self, ds: Dataset, sink: Sink) -> Flow:
        if any(sink is s for _, s in self.outputs):
            raise ValueError("a sink takes one output only")
        self.outputs.append((ds, sink))
        return self

    def execute(self) -> list[Any]:
        if not self.outputs:
            raise ValueError(f"{self.name} has no output")
        self.spark.sparkContext.setJobDescription(self.name)
        return [sink(ds) for ds, sink in self.outputs]


class Fluent:
    """Operators as methods: Fluent(flow, ds).apply(op, ...).persist(sink).execute()."""

    def __init__(self, flow: Flow, ds: Dataset):
        self.flow, self.ds = flow, ds

    def apply(self, operator: Callable[..., Dataset], *args: Any, **more: Any) -> Fluent:
        return Fluent(self.flow, operator(self.ds, *args, **more))

    def persist(self, sink: Sink) -> Fluent:
        self.flow.persist(self.ds, sink)
        return self

    def execute(self) -> list[Any]:
        return self.flow.execute()
