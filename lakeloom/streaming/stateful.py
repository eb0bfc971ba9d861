"""Run a step function over keyed events in order, as a batch over sorted partitions or as a stream with state.

A step takes (state, row) and gives (state, output rows); state is a JSON-able dict, {} at first. The batch form
streams through each partition, so a key of any size needs the state of one key only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

Step = Callable[[dict, dict], tuple[dict, list[dict]]]
ROWS_PER_BATCH = 10_000


def in_batch(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Rows with a null key are a key of their own; whole numbers stay whole, whatever nulls there are."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, {}, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, {}
                state, made = step(state, row)
                out += [dict(zip(keys, key)) | m for m in made]
                if len(out) >= ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_stream(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Rows of a micro-batch are sorted by `order` within their key; state lives on between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        out = []
        for row in pd.concat(list(frames)).sort_values(order, kind="stable").to_dict("records"):
            state, made = step(state, row)
            out += [dict(zip(keys, key)) | m for m in made]
        held.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
