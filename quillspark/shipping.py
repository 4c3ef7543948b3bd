"""Sending this package to Python workers, which needn't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

_SHIPPED: set[str] = set()

#: Rows that a function on whole pages or texts takes at once. What it makes of them is many times their size, and Spark's batches have up to 10 000 rows or 64 MB.
ROWS = 256


def ship(spark: SparkSession) -> None:
    """Adds the package to the files of the application, once; Spark hands them to executors, also to those that come later."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    name = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quillspark-")), "quillspark.zip")
    with zipfile.ZipFile(name, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def in_parts(batches: Iterator, rows: int = ROWS) -> Iterator:
    """Batches (a series, or a tuple of series) cut into parts of so many rows, so that a worker holds the results of one part at a time."""
    for batch in batches:
        several = isinstance(batch, tuple)
        for at in range(0, len(batch[0] if several else batch), rows):
            yield tuple(x.iloc[at : at + rows] for x in batch) if several else batch.iloc[at : at + rows]


def vectorised(returns: str) -> Callable:
    """Makes a function on pandas series, with type hints, one on columns; nothing needs a session until it is called."""

    def wrap(function: Callable) -> Callable:
        def on_columns(*columns: Column | str) -> Column:
            ship(SparkSession.active())
            return F.pandas_udf(function, returns)(*columns)

        on_columns.__name__, on_columns.__doc__, on_columns.__wrapped__ = function.__name__, function.__doc__, function
        return on_columns

    return wrap


def _series(batches: Iterator) -> Iterator:
    """Arrow arrays (one, or a tuple of them) as series of so many rows; what isn't at hand stays in Arrow's memory."""
    for batch in batches:
        several = isinstance(batch, tuple)
        columns = batch if several else (batch,)
        del batch
        for at in range(0, len(columns[0]), ROWS):
            part = tuple(x.slice(at, ROWS).to_pandas() for x in columns)
            yield part if several else part[0]
        # Spark reads the next batch before this variable would be set again
        del columns


def _array(found: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    """A series, or a frame with a column for each field of a struct, as an array of Arrow."""
    if isinstance(found, pd.Series):
        return pa.array(found, type=kind, from_pandas=True)
    return pa.StructArray.from_arrays([pa.array(found[x.name], type=x.type, from_pandas=True) for x in kind], fields=list(kind))


def vectorised_in_parts(returns: str) -> Callable:
    """vectorised() for functions on iterators of series that hold whole pages: each series has ROWS rows at most.

    Spark would make a whole batch of Arrow, up to 64 MB, Python's objects first, several times its size; here only a part is.
    """

    def wrap(function: Callable) -> Callable:
        def on_columns(*columns: Column | str) -> Column:
            ship(SparkSession.active())
            kind = to_arrow_type(DataType.fromDDL(returns))

            def on_arrays(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for found in function(_series(batches)):
                    yield _array(found, kind)

            on_arrays.__name__ = function.__name__  # for plans
            return F.arrow_udf(on_arrays, returns)(*columns)

        on_columns.__name__, on_columns.__doc__, on_columns.__wrapped__ = function.__name__, function.__doc__, function
        return on_columns

    return wrap
