"""Columns computed from Arrow batches inside tasks, beside the columns a frame has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def named(column: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(df: DataFrame, taken: Iterable[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``taken``; computed columns win over columns of the same name."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def packed(columns: Sequence[str]) -> Column:
    """The columns as one struct ``_doc``: whatever their names are, they clash with none of an operator's own."""
    return F.struct(*[named(c) for c in columns] or [F.lit(None).cast("string").alias("none")]).alias("_doc")


def unpacked(columns: Sequence[str]) -> list[Column]:
    """The columns out of ``packed(columns)``, under their own names."""
    return [F.col("_doc").getField(c).alias(c) for c in columns]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; of the empty text for no id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))


def add_columns(
    df: DataFrame,
    reads: Sequence[Column],
    schema: str,
    work: Callable[[], Callable[..., list[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all, unless named) of ``df``, then those of ``schema``.

    ``work()`` is called once per task and gives a function from the Arrow arrays of ``reads`` to the
    arrays of ``schema``, row for row. A kept column whose name ``schema`` uses is left out. No shuffle.
    """
    new = StructType.fromDDL(schema)
    kept = [c for c in others(df, new.names) if keep is None or c in keep]
    source = df.select(*[c.alias(f"_read{i}") for i, c in enumerate(reads)], *[named(c).alias(f"_kept{i}") for i, c in enumerate(kept)])
    n, names = len(reads), [*kept, *new.names]
    carried = [StructField(c, f.dataType, f.nullable) for c, f in zip(kept, source.schema.fields[n:], strict=True)]

    def run(batches):
        compute = work()
        for batch in batches:
            if batch.num_rows:
                made = compute(*batch.columns[:n])
                yield pa.RecordBatch.from_arrays([*batch.columns[n:], *made], names=names)

    return source.mapInArrow(run, StructType([*carried, *new.fields]))
