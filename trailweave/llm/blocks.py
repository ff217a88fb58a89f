"""Arrow helpers: bounded blocks of texts inside a task."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trailweave.session import ensure_checkpoint_dir

_SPACE = re.compile(rb"[ \t-\r]")


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def byte_slices(array: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with about ``most`` bytes; one row at least."""
    if not len(array):
        return
    sizes = np.nan_to_num(pc.binary_length(array).to_numpy(zero_copy_only=False).astype(float))
    runs = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(array)]
    yield from zip(cuts, cuts[1:])


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in record batches of about ``most`` bytes of ``column``."""
    for batch in batches:
        for start, stop in byte_slices(batch.column(column), most):
            yield batch.slice(start, stop - start)


def pieces_at_spaces(text: bytes, most: int = 1 << 22) -> Iterator[bytes]:
    """``text`` in pieces of about ``most`` bytes that end before an ASCII white space, so that no word is cut.

    What a task holds of a text as separate words is bounded so; a single longer word stays whole.
    """
    at = 0
    while len(text) - at > most:
        space = _SPACE.search(text, at + most)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def staged(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again, and the folder, for whoever drops it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path
