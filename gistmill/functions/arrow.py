"""Arrow maps over whole texts in bounded batches: the way out of SQL where offsets or parsers are needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows are handed on once a batch holds so many.
BATCH_ROWS = 4096


#: Bytes of (compressed) input for one task of a map that takes much time a byte; from MOST_TASKS on the scan's own tasks do.
TASK_BYTES, MOST_TASKS = 2 << 20, 20_000


#: Bytes of one batch that goes to a Python worker (a longer single row goes alone).
BATCH_BYTES = "8m"


def bounded(df: DataFrame) -> DataFrame:
    """Sees to it that the session bounds batches by bytes, as a count of rows says nothing about long texts.

    A bound that the session has already is left as it is.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out evenly (by columns if named, so that groups of these need no other shuffle), for a costly map to keep all cores busy.

    A scan makes one task of a row group, however many tasks it plans, and a small table may be one row group. So inputs of up
    to MOST_TASKS times TASK_BYTES (by the optimizer's estimate, nothing runs for it) are dealt out in turn, to two tasks a core
    at least. Larger ones have tasks enough and are not shuffled; nor are streams.
    """
    if df.isStreaming:
        return df
    # a join's own estimate is the product of its sides', so the tables that are read count
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.repartition(tasks, *by) if tasks <= MOST_TASKS else df


def map_texts(df: DataFrame, id_col: str, text_col: str, rows: Callable[[str], Iterator[tuple]], schema: str, types: list[tuple[str, pa.DataType]]) -> DataFrame:
    """For every text the rows that ``rows`` yields, after the id. A null text yields nothing. No shuffle."""
    id_type = df.schema[id_col].dataType
    names = ["id", *(n for n, _ in types)]

    def run(batches):
        for batch in batches:
            at, columns = [], [[] for _ in types]
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                for row in rows(text):
                    at.append(k)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                if len(at) >= BATCH_ROWS:
                    yield _batch(batch, at, columns, types, names)
                    at, columns = [], [[] for _ in types]
            if at:
                yield _batch(batch, at, columns, types, names)

    out = bounded(spread(df.select(F.col(id_col), F.col(text_col).cast("string")))).mapInArrow(run, f"id {id_type.simpleString()}, {schema}")
    return out.withColumnRenamed("id", id_col)


def _batch(batch, at, columns, types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True))], names=names)
