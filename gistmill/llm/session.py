"""Session helpers: shared checkpoints, arrow maps over whole texts, surrogate-safe schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions.arrow import bounded
from gistmill.functions.shared import shared_folder

#: Bytes of text that one numpy or Python step looks at together; a longer single text goes alone.
BLOCK_BYTES = 1 << 20


#: Spark's switch that removes the shuffle files of a query as soon as it has ended, instead of when the driver collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Frames made inside leave no shuffle files behind once an action on them has ended.

    For operators of many small steps, whose files would otherwise pile up (three for each task of each exchange). It only
    frees space: a frame that is computed once more shuffles once more. Frames that are handed out belong outside.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def narrow(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns, whatever their names, are never read."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id):
    """True where crc32 of the id as text leaves no remainder modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column without nulls (null becomes the empty text)."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.string()).fill_null("")


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, each with one row at least."""
    import numpy as np

    if not len(texts):
        return
    sizes = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(sizes, int(sizes[start]) + most, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def map_blocks(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], Iterator[dict]], types: pa.Schema) -> DataFrame:
    """``mapInArrow`` in blocks of bounded text; ``step`` gets a record batch and yields column dicts."""

    def run(batches):
        for batch in batches:
            for start, end in blocks(texts_of(batch)):
                for out in step(batch.slice(start, end - start)):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in types], schema=types)

    return bounded(df).mapInArrow(run, schema)
