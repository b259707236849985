"""Small helpers around ``mapInArrow``: one kernel call per row, Arrow in and out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.storage import small_batches

#: The six characters that separate words in every contract here.
BLANKS = " \t\n\x0b\x0c\r"


#: What operators keep from task to task, by operator: how to drop it.
kept: dict[str, Callable[[], None]] = {}


def give_back(own: str = "") -> None:
    """Drop what other operators keep, and return freed memory to the system, as Python
    workers live on after a task."""
    for name, drop in kept.items():
        if name != own:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_text(df: DataFrame, ident: str, text: str, schema: str, kernel: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``(ident, *kernel(text))`` per row; null texts reach the kernel as ''.

    ``kernel()`` is called once per task and returns the row function. ``schema``
    lists the columns after the id.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(ident).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = df.schema[ident].dataType.simpleString()
    full = f"{ident} {kind}, {schema}"
    names = [x.split()[0] for x in full.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, wanted = kernel(), None
        for batch in batches:
            made = [one(t) for t in batch.column(1).to_pylist()]
            wanted = wanted or types
            columns = [batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * (len(names) - 1), wanted, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    return rows.mapInArrow(run, full)
