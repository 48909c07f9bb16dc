"""Arrow batches in bounded slices, for the operators of this folder that work in Python tasks.

Every function here sees one slice of a partition at a time, so a task holds a few megabytes of text
(or one text, if that is longer) whatever the partition's size.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def vocabulary(name: str) -> str:
    """Place of a tokenizer file: an absolute path, or the name of a file of the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict[tuple, object] = {}
_asked: set[tuple] = set()


def held(key: tuple, make: Callable[[], object]) -> object:
    """An object that a worker process keeps between tasks, such as a vocabulary with its table of words.

    It goes as soon as the worker runs a task of `add_columns` that does not ask for it.
    """
    _asked.add(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def with_own_tables(start: Callable[[], Callable]) -> Callable:
    """What `start` gives; then the tables that it has not asked for go."""
    _asked.clear()
    f = start()
    gone = [_held.pop(k) for k in set(_held) - _asked]
    if gone:
        gone.clear()
        gc.collect()
    return f


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python end at a few megabytes (or one row), where the session has not set a bound of its own.

    Rows are texts here: at the default of 64 MB, batches take most of the memory that an executor has outside its heap.
    """
    now = str(spark.conf.get(_BATCH_SETTING)).lower().removesuffix("b")
    if now in (str(_BATCH_DEFAULT), "64m"):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of the text column pass a multiple of the limit."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    groups = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        yield batch.slice(start, stop - start)


def as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 of a text column; NULL reads as empty."""
    return [b or b"" for b in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]


def as_texts(batch: pa.RecordBatch, text: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def add_columns(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType]],
    start: Callable[[], Callable[[pa.RecordBatch], list]],
    limit: int = SLICE_BYTES,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """`df` with computed columns at its end, in one narrow pass.

    `start()` runs once per task and gives the function that maps a slice to one list or array per field.
    Columns of `df` with the name of a computed one (in any case) are replaced; those in `drop` go.
    """
    bound_batches(df.sparkSession)
    taken = {n.lower() for n, _ in fields} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])
    types = [to_arrow_type(t) for _, t in fields]
    names = [f.name for f in schema.fields]
    kept_names = [f.name for f in kept]

    def run(batches):
        f = with_own_tables(start)
        for batch in batches:
            for part in slices(batch, text, limit):
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(f(part), types)]
                old = [part.column(part.schema.get_field_index(n)) for n in kept_names]
                yield pa.RecordBatch.from_arrays([*old, *made], names)

    return df.mapInArrow(run, schema)


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
