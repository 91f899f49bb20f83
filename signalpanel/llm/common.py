"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.session import ensure_checkpoint_dir

#: One white-space character of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
#: Rows per Arrow batch sent to Python: whole texts, so far below the default.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole texts small (a Python worker holds one
    batch at a time, so this bounds its memory whatever the input)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name inside the checkpoint folder that driver and
    executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (NULL: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts
    the lineage like a checkpoint, in a smaller, column-wise form."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pack(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            small = [None if t is None else z.compress(t.encode("utf-8")) for t in b.column(text).to_pylist()]
            k = b.schema.get_field_index(text)
            yield b.set_column(k, pa.field(text, pa.binary()), pa.array(small, pa.binary()))
    return run


def packed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its column ``text`` compressed, so that a shuffle of whole
    texts writes and holds a third of the bytes."""
    schema = ", ".join(f"`{c}` {'binary' if c == text else kind}" for c, kind in df.dtypes)
    return df.mapInArrow(_pack(text), schema)


def unpack(column: pa.Array) -> pa.Array:
    """The texts of a ``packed`` column."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else z.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def string_hashes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """128 hash bits (XXH3) of the UTF-8 bytes of each string, as two halves."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(x) for x in strings.cast(pa.binary()).to_pylist()])
    halves = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()
