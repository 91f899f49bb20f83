"""Slabs: runs of whole documents, bounded in bytes, as the unit that gathers
statistics from a corpus and takes them back.

A task cuts its documents into slabs, sums each slab on its own (one entry per
distinct key and slab, so no key is hotter than the number of slabs), and
stores the slab. The sums of all slabs meet in Spark aggregates; each slab then
takes back just the entries that it holds, by a cogroup on the slab's number.
Nothing corpus-wide is broadcast or held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import shared_folder

#: Bytes of text in a slab (a longer text is a slab of its own), and rows at most.
SLAB_BYTES = 16 << 20
SLAB_ROWS = 100_000
#: Slabs in one stored file.
SLABS_PER_FILE = 16


def cut_slabs(batches: Iterator[pa.RecordBatch], text: str = "t", most_bytes: int = SLAB_BYTES,
              most_rows: int = SLAB_ROWS) -> Iterator[tuple[int, pa.Table]]:
    """Number (unique over the tasks of a stage) and rows of each slab of a task."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held, size, rows = [], 0, 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        first = 0
        for k, n in enumerate(lengths):
            if rows and (size + n > most_bytes or rows >= most_rows):
                held.append(b.slice(first, k - first))
                yield number, pa.Table.from_batches(held).combine_chunks()
                held, size, rows, first, number = [], 0, 0, k, number + 1
            size, rows = size + n, rows + 1
        held.append(b.slice(first))
    if rows:
        yield number, pa.Table.from_batches(held).combine_chunks()


def store_slabs(slabs: DataFrame) -> DataFrame:
    """Write slab rows to the shared folder, a few per file, and read them again."""
    path = shared_folder(slabs.sparkSession, "slabs")
    slabs.write.option("maxRecordsPerFile", SLABS_PER_FILE).parquet(path)
    return slabs.sparkSession.read.schema(slabs.schema).parquet(path)
