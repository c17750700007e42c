"""Plain functions over Arrow batches, chained inside one Python pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BatchFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows and bytes handled at once inside a task, so that memory follows single texts, not Spark's batch size.
SLICE_ROWS, SLICE_BYTES = 256, 256_000
#: Rows that Spark hands to a worker at once, and the setting that tells.
ARROW_ROWS, ARROW_SETTING, ARROW_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def slices(
    batches: Iterator[pa.RecordBatch], rows: int | None = None, size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, few at a time: one, or as many as both bounds hold; empty batches go."""
    rows, size = rows or SLICE_ROWS, size or SLICE_BYTES
    for batch in batches:
        left = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while left:
            part = left.pop()
            if part.num_rows == 1 or part.nbytes <= size:
                yield part
            else:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``added`` columns at the end; columns of the same names are replaced."""
    kept = {name: batch.column(name) for name in batch.schema.names if name not in added}
    return pa.RecordBatch.from_pydict(kept | added)


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send ``ARROW_ROWS`` rows at once, as thousands of whole texts fill both sides' memory; a size the session names stays."""
    if spark.conf.get(ARROW_SETTING) == ARROW_DEFAULT:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))


def through(df: DataFrame, steps: list[BatchFn], schema: str, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Send the rows through ``steps``, one after the other, in one pass of Python workers, sliced to ``rows`` and ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = slices(batches, rows, size)
        for step in steps:
            made = step(made)
        return made

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def schema_with(df: DataFrame, added: str) -> str:
    """The schema of ``df`` plus ``added`` fields (DDL), which replace fields of the same names."""
    names = {part.split()[0] for part in added.split(", ")}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in names]
    return ", ".join([*kept, added])
