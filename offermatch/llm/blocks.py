"""A stated query set against all rows, in blocks: rows stay where their block is, queries visit it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: Any) -> np.ndarray:
    """A list column, all lists equally long, as a matrix of its own type."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def finite(vector: Column) -> Column:
    """Not null, and every component finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def first_of_each(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first ``k``: higher score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, who))
    first = np.searchsorted(who[order], who[order])
    return order[np.arange(len(order)) - first < k]


def visit(rows: DataFrame, queries: DataFrame, blocks: int, hold: Callable, probe: Callable, schema: str) -> DataFrame:
    """Every query meets every row once.  ``rows`` and ``queries`` have their columns but the ones only
    queries have, which are null in rows; the first of those tells them apart.

    ``hold`` makes of a block's rows (an Arrow table) what ``probe(held, queries)`` searches for one batch of
    queries; it yields record batches of ``schema``.  Rows are dealt by a hash of ``id``.  A task holds one block
    and reads the queries batch by batch.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    own = [f for f in queries.schema if f.name not in rows.columns]
    mark = own[0].name

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers = table.column("block").to_numpy()
            for number in np.unique(numbers).tolist():
                if number != block:
                    block, parts, held = number, [], None
                here = table.filter(pa.array(numbers == number))
                asks = here.column(mark).is_valid()
                parts += [part for part in [here.filter(pc.invert(asks))] if len(part)]
                asked = here.filter(asks)
                if len(asked) and parts:
                    if held is None:
                        held = hold(pa.concat_tables(parts))
                    yield from probe(held, asked)

    dealt = F.pmod(F.xxhash64("id"), F.lit(blocks))
    visits = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    held_rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in own], dealt.alias("block"))
    both = held_rows.unionByName(queries.select("*", visits.alias("block")))
    return both.repartition("block").sortWithinPartitions("block", F.col(mark).isNotNull()).mapInArrow(search, schema)
