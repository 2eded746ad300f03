"""Order-dependent folds over a stream of rows per key, in constant memory.

Greedy packing, chunk boundaries and congestion windows depend on every earlier decision, so no window frame expresses
them.  Rows are dealt by key, sorted within the partition, and folded batch by batch with the state carried over: a task
holds one Arrow batch and one state, however long a key's stream is.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, tuple]], outputs: str) -> DataFrame:
    """df with the columns `outputs` (a DDL string), which step(state, row) -> (state, values) yields row by row.

    Each key starts from start(); rows come in `order`, which must leave no tie that matters.
    """
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([*df.schema, *added])
    arrow = to_arrow_schema(schema)
    names = df.columns

    def run(batches):
        current, state = None, None
        for b in batches:
            rows = b.to_pylist()
            values = []
            for row in rows:
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                state, value = step(state, row)
                values.append(value)
            columns = [pa.array([v[i] for v in values], arrow.field(len(names) + i).type) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=arrow.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
