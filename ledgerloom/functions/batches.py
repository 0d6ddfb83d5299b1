"""Rows of an Arrow batch in pieces of bounded size, so that what a parser makes of them is bounded too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of input that are parsed and handed on together: parsed rows are several times as large.
PIECE = 1 << 20


def pieces(columns: tuple[pa.Array, ...], limit: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of at most ``limit`` bytes of text, but always a row at least; a null has no bytes."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    start, rows, before = 0, len(ends), 0
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield tuple(c.slice(start, stop - start) for c in columns)
        start, before = stop, int(ends[stop - 1])


def by_piece(build: Callable[..., pa.Array], schema: str, *columns: Column, limit: int = PIECE, once: bool = True) -> Column:
    """``build(*lists, kind)`` over pieces of the texts in ``columns``: an Arrow array of ``kind`` with an item per row.

    A batch is never held as Python objects as a whole, nor is its result. ``once``: the optimizer may not compute it twice
    or move filters below it.
    """
    kind = to_arrow_type(DataType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch if isinstance(batch, tuple) else (batch,)
            for piece in pieces(texts, limit):
                yield build(*[p.to_pylist() for p in piece], kind)

    given = pa.Array if len(columns) == 1 else tuple[(pa.Array,) * len(columns)]
    run.__annotations__ = {"batches": Iterator[given], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, schema)
    return (made.asNondeterministic() if once else made)(*columns)
