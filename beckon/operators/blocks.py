"""Compare all rows of a group on both sides without emitting pairs.

A group (all rows of one key) is cut into blocks of about ``block_rows`` rows
on each side, and every left block meets every right block of its group.  The
two sides travel in one shuffle, sorted by block pair, and a streaming reader
hands one block pair at a time to a function that returns a result per left
row.  A group of any size is spread over many tasks, a task holds two blocks at
a time, and small groups share a task without a call into Spark for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEFT_ROWS, RIGHT_ROWS = "_left_rows", "_right_rows"


def list_column(column):
    """Flattened values and row offsets of a list column."""
    import numpy as np

    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = values.offsets.to_numpy()
    return values.flatten(), np.asarray(ends - ends[0])


def with_group_sizes(df: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_left_rows`` and ``_right_rows`` of the key; drop keys of one side only.

    ``sizes`` is a stored table with one row per key present on both sides, so
    AQE can split the partition of a key with very many rows.
    """
    return df.join(sizes.select(*keys, LEFT_ROWS, RIGHT_ROWS), keys)


def block_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str,
                block_rows: int, function: Callable[[pa.Table, pa.Table], pa.Table],
                schema: T.StructType) -> DataFrame:
    """Run ``function`` on every (left block, right block) of each key.

    Both sides carry ``_left_rows`` and ``_right_rows``, the (approximate)
    sizes of their group; they only decide into how many blocks it is cut.
    """
    def blocks(rows: str) -> Column:
        return F.greatest(F.ceil(F.col(rows) / F.lit(float(block_rows))), F.lit(1)).cast("int")

    def own(row_id: str, rows: str) -> Column:
        return F.pmod(F.xxhash64(row_id), blocks(rows)).cast("int")

    def every(rows: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(rows) - 1))

    sizes = [LEFT_ROWS, RIGHT_ROWS]
    lefts = (left.withColumn("_lb", own(left_id, LEFT_ROWS))
             .withColumn("_rb", every(RIGHT_ROWS)).withColumn("_side", F.lit(0)).drop(*sizes))
    rights = (right.withColumn("_rb", own(right_id, RIGHT_ROWS))
              .withColumn("_lb", every(LEFT_ROWS)).withColumn("_side", F.lit(1)).drop(*sizes))
    group = [key, "_lb", "_rb"]
    both = (lefts.unionByName(rights, allowMissingColumns=True)
            .repartition(*group).sortWithinPartitions(*group, "_side"))
    return both.mapInArrow(_reader(group, function, schema), schema)


def _reader(group: list[str], function: Callable[[pa.Table, pa.Table], pa.Table],
            schema: T.StructType):
    """Turn the sorted batches of a partition into calls per block pair."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)

    def starts_of_groups(table: pa.Table):
        import numpy as np
        import pyarrow.compute as pc

        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for name in group:
            column = table[name].combine_chunks()
            change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(change)

    def run(table: pa.Table, starts, stops) -> Iterator[pa.Table]:
        import numpy as np

        firsts_right = np.append(np.flatnonzero(table["_side"].to_numpy() == 1), table.num_rows)
        middles = firsts_right[np.searchsorted(firsts_right, starts)]
        for start, middle, stop in zip(starts.tolist(), middles.tolist(), stops.tolist()):
            if start < middle < stop:
                yield function(table.slice(start, middle - start),
                               table.slice(middle, stop - middle))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            starts = starts_of_groups(table)
            # the last group may go on in the next batch
            results = list(run(table, starts[:-1], starts[1:]))
            held = table.slice(int(starts[-1]))
            if results:
                yield from pa.concat_tables(results).cast(arrow_schema).combine_chunks(
                ).to_batches()
        if held is not None:
            held = held.combine_chunks()
            for result in run(held, np.array([0]), np.array([held.num_rows])):
                yield from result.cast(arrow_schema).combine_chunks().to_batches()

    return read
