"""Running array functions over text columns inside Spark tasks, and small shared helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textkit

Measure = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list]


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted name with as many underscores as it takes not to clash (case-blind) with a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def measure_texts(df: DataFrame, fn: Measure, fields: str, into: str, text: str = "text", carry: list[str] | None = None, limit: int = 1 << 20) -> DataFrame:
    """The carried columns (default: all) and a struct column `into` with the fields that
    fn(bytes, offsets, rows) returns as arrays, one entry per text. Texts come in runs of
    about `limit` bytes, whole texts always; null texts come as empty ones."""
    carry = df.columns if carry is None else carry
    inner = T._parse_datatype_string(fields)
    source = df.select(*[F.col(f"`{c}`") for c in carry])
    out = T.StructType([*source.schema.fields, T.StructField(into, inner)])
    if text in carry and isinstance(source.schema[text].dataType, T.StringType):
        at = carry.index(text)  # carried already: it crosses to the worker once
    else:
        at = len(carry)
        source = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias(free_name(df, "text")))
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [arrow.field(i).type for i in range(len(carry))]
        parts = [f.type for f in arrow.field(len(carry)).type]
        names = [f.name for f in arrow.field(len(carry)).type]
        for batch in batches:
            for rows in textkit.slices(batch, at, limit):
                raw, offs = textkit.buffers(rows.column(at))
                found = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(fn(raw, offs, rows), parts)]
                columns = [c.cast(t) for c, t in zip(rows.columns, kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(found, names)], schema=arrow)

    return source.mapInArrow(run, out)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
