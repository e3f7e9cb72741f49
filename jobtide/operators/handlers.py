"""User functions over task payloads: the one place where rows meet Python."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from jobtide.operators.skew import settled

Handler = Callable[[dict[str, str], "Deadline"], None]

RESULT = "id {id_type}, type string, ok boolean, error string, known_type boolean, duration_seconds double"


class Deadline:
    """Time left for one call. A handler that respects it calls ``check`` between steps."""

    def __init__(self, seconds: float):
        self.ends_at = time.monotonic() + seconds

    def remaining(self) -> float:
        return self.ends_at - time.monotonic()

    def check(self) -> None:
        if self.remaining() <= 0:
            raise TimeoutError("deadline exceeded")


def noop(payload: dict[str, str], deadline: Deadline) -> None:
    """Succeeds at once."""


def execute(tasks: DataFrame, registry: Mapping[str, Handler], partitions: int | None = None) -> DataFrame:
    """Runs the handler of each task's type; one result row per task, errors as text.

    A type without a handler gives ``known_type`` false. Handlers must stand being run again, since a
    lost partition is recomputed. ``partitions`` spreads a narrow input (such as a claim) by task id;
    the spread does not depend on the type, so one busy type does not fill one task.
    """
    handlers = dict(registry)
    rows = tasks.select("id", "type", "payload", "timeout_seconds")
    if partitions:
        rows = rows.repartition(partitions, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                handler = handlers.get(row.type)
                error, began = None, time.monotonic()
                if handler is not None:
                    try:
                        handler(dict(row.payload or {}), Deadline(float(row.timeout_seconds)))
                    except Exception as problem:  # a failing handler is data, not a failed job
                        error = str(problem) or type(problem).__name__
                out.append((row.id, row.type, handler is not None and error is None, error, handler is not None, time.monotonic() - began))
            yield pd.DataFrame(out, columns=["id", "type", "ok", "error", "known_type", "duration_seconds"])

    return rows.mapInPandas(run, RESULT.format(id_type=rows.schema["id"].dataType.simpleString()))


def execute_once(tasks: DataFrame, registry: Mapping[str, Handler], partitions: int | None = None) -> DataFrame:
    """``execute`` with its results kept in the checkpoint folder. The deltas made from the results are
    written one by one; without this each write would run the handlers again."""
    return settled(execute(tasks, registry, partitions))
