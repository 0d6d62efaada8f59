"""Work that stays spread: joins that send nothing through the driver, and small groups in Arrow batches, where a grouped map takes a call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are put into one batch of results.
BATCH_ROWS = 1000


def dealt(rows: DataFrame) -> DataFrame:
    """Rows for a join that both sides are shuffled for.

    What Spark takes for small by the size of its files may be large in memory
    (arrays, equal values), and a broadcast passes the driver whole.
    """
    return rows.hint("merge")


def batches_of(rows: Iterator[tuple], schema: T.StructType, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


def by_group(rows: DataFrame, keys: list[str], each: Callable[[list[dict]], list[tuple]], schema: T.StructType) -> DataFrame:
    """``each`` over the rows of every group, as a grouped map would do it.

    Groups lie together in their partitions; a batch holds many, and one that
    spans batches is carried over.  So small groups cost no call each.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    yield from each(held)
                    held = []
                held.append(row)
        if held:
            yield from each(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(found(batches), schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
