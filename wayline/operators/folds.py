"""Functions of a lane's samples one after another, with a state carried along, and never a lane in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.frame import LaneFrame

FIRST = "__first"


def _stepped(batches: Iterator[pa.RecordBatch], start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], tuple[Any, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        first = np.flatnonzero(batch.column(FIRST).to_numpy(zero_copy_only=False))
        edges = np.unique(np.concatenate([[0], first, [batch.num_rows]]))
        begins, rows, out = set(first.tolist()), batch.drop_columns([FIRST]), []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            state, made = step(start() if a in begins else state, rows.slice(a, b - a))
            if made.num_rows:
                out.append(made)
        if out:
            yield pa.concat_batches(out)


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], tuple[Any, pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """Rows of each key in an order, batch after batch, through ``step(state, batch) -> (state, rows)``; ``start()`` is the state at a key's first row.

    One shuffle by key, one sort, one pass of a Python worker: a task holds a batch and the state.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn(FIRST, first).mapInArrow(partial(_stepped, start=start, step=step), schema)


def fold_lanes(frame: LaneFrame, start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], tuple[Any, pa.RecordBatch]], fields: str) -> LaneFrame:
    """The frame with fields that a function of state and Arrow batch makes: ``step(state, batch)`` gives the next state and an array for each field.

    fields: their names and types, as in a schema ("level double"). Lanes of any length: batches come in order of the samples.
    """
    made = T.StructType.fromDDL(fields)
    kept = [*frame.keys, frame.seq, *([frame.clock] if frame.clock else [])]
    schema = T.StructType([*(frame.df.schema[c] for c in kept), *made])

    def run(state: Any, batch: pa.RecordBatch) -> tuple[Any, pa.RecordBatch]:
        state, columns = step(state, batch)
        return state, pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *made.names])

    return frame.over(folded(frame.df, frame.keys, [frame.seq], start, run, schema), fields=tuple(made.names), components={})


def _kept(state: float | None, batch: pa.RecordBatch, column: str, tol: float) -> tuple[float | None, pa.RecordBatch]:
    """The rows more than ``tol`` after the last one kept."""
    keep = []
    for x in batch.column(column).to_pylist():
        some = state is None or x - state > tol
        keep.append(some)
        state = x if some else state
    return state, batch.filter(pa.array(keep, pa.bool_()))


def _nothing() -> None:
    return None


def thinned(df: DataFrame, keys: Sequence[str], column: str, tol: float, more: Sequence[str] = ()) -> DataFrame:
    """Rows of each key, in order of a number column (then ``more``), without those within tol of the last one kept; in linear time."""
    return folded(df, keys, [column, *more], _nothing, partial(_kept, column=column, tol=tol), df.schema)
